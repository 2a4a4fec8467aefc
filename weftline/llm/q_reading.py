"""Problem 9: the reading level of each English document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.reading import assign_levels, read_models
from weftline.sources.tables import table


def _levels(spark: SparkSession, data_dir: str) -> DataFrame:
    models = read_models(table(spark, data_dir, "reading_refs"), "ref_id", "text", "band")
    return assign_levels(table(spark, data_dir, "documents"), "doc_id", "text", models)


def p9_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, band) of each document with 60 words or more of English running text."""
    return _levels(spark, data_dir).select("doc_id", "band")


def p9_profile(spark: SparkSession, data_dir: str) -> DataFrame:
    """(source, band, docs, words): what each source demands of its readers."""
    docs = table(spark, data_dir, "documents").select("doc_id", "source")
    return docs.join(_levels(spark, data_dir), "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))


QUERIES = {"p9_found": p9_found, "p9_profile": p9_profile}
ORACLE: dict[str, str] = {}
