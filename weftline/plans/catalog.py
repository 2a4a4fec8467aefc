"""All named queries of the core and the SQL that each must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ["moments", "texts", "duplicates", "vector_search", "retrieval", "graph_queries", "relational", "story_queries", "service", "events"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"weftline.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"weftline.plans.{m}").ORACLE.items()}
