"""Problem 8: passages of held-out items in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.leaks import find_leaks
from weftline.sources.tables import table


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, item_id) of each document and item of which it holds the whole or 20 words in one stretch."""
    return find_leaks(table(spark, data_dir, "documents"), "doc_id", "text", table(spark, data_dir, "eval_items"), "item_id", "text").distinct()


def p8_suites(spark: SparkSession, data_dir: str) -> DataFrame:
    """(suite, items, docs): leaked items and the documents that hold them, by suite."""
    items = table(spark, data_dir, "eval_items").select("item_id", "suite")
    return p8_found(spark, data_dir).join(items, "item_id").groupBy("suite").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("docs"))


QUERIES = {"p8_found": p8_found, "p8_suites": p8_suites}
ORACLE: dict[str, str] = {}
