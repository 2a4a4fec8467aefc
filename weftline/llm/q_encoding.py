"""Problem 7: the corpus as token ids of byte_bpe_50k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.encoding import encode_texts
from weftline.sources.tables import table


def p7_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode_texts(table(spark, data_dir, "documents"), "doc_id", "text")


def p7_lengths(spark: SparkSession, data_dir: str) -> DataFrame:
    """(source, docs, tokens): corpus size in tokens by source."""
    docs = table(spark, data_dir, "documents").select("doc_id", "source")
    return docs.join(p7_ids(spark, data_dir).select("doc_id", F.size("ids").alias("n")), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


QUERIES = {"p7_ids": p7_ids, "p7_lengths": p7_lengths}
ORACLE: dict[str, str] = {}
