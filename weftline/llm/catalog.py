"""Named queries of this folder and their SQL."""

from __future__ import annotations

from weftline.llm import q_encoding, q_formatting, q_fusion, q_groups, q_history, q_leaks, q_near, q_reading

MODULES = [q_history, q_groups, q_near, q_formatting, q_fusion, q_encoding, q_leaks, q_reading]  # imported here, so that a missing library shows at the import of this module


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
