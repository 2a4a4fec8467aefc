"""Problem 5: one UTC moment per row out of mixed timestamp forms and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.instants import source_zones, to_moments
from weftline.operators.materialize import materialize
from weftline.sources.tables import table


def _dated(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "articles").select("id", "published_at", "source_domain", F.unix_micros("retrieved_at").alias("_ingested")).dropDuplicates(["id"])


def _zones(spark: SparkSession, data_dir: str, every: bool = False) -> DataFrame:
    """Zones estimated from the articles' times of arrival. ai_models has neither such times nor an order that follows time, so its sources without a
    declared zone get the zone that their articles tell."""
    articles = _dated(spark, data_dir)
    return materialize(source_zones(articles, "published_at", "source_domain", table(spark, data_dir, "publishers"), "_ingested", every), "zones")


def article_moments(spark: SparkSession, data_dir: str) -> DataFrame:
    """(id, utc_us) of each article; a row delivered twice counts once."""
    return to_moments(_dated(spark, data_dir), "published_at", "source_domain", table(spark, data_dir, "publishers"), "_ingested").select("id", "utc_us")


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(source_table, row_id, utc_us) of every row of ai_models and article whose text fixes one moment."""
    pub, zones = table(spark, data_dir, "publishers"), _zones(spark, data_dir)
    seen = to_moments(table(spark, data_dir, "ai_models").select("rec_id", "seendate", "domain"), "seendate", "domain", pub, zones=zones.withColumnRenamed("source_domain", "domain"))
    told = to_moments(_dated(spark, data_dir), "published_at", "source_domain", pub, zones=zones)
    one = seen.select(F.lit("ai_models").alias("source_table"), F.col("rec_id").alias("row_id"), "utc_us")
    two = told.select(F.lit("articles").alias("source_table"), F.col("id").alias("row_id"), "utc_us")
    return one.unionByName(two).filter(F.col("utc_us").isNotNull())


def p5_zones(spark: SparkSession, data_dir: str) -> DataFrame:
    """(source_domain, tz, est_tz, rows, violations): what the estimation makes of each publisher's articles when its declared zone is not looked at."""
    declared = table(spark, data_dir, "publishers").select("source_domain", "tz").dropDuplicates(["source_domain"])
    return _zones(spark, data_dir, every=True).join(declared, "source_domain").select("source_domain", "tz", "est_tz", "rows", "violations")


QUERIES = {"p5_found": p5_found, "p5_zones": p5_zones}
ORACLE: dict[str, str] = {}
