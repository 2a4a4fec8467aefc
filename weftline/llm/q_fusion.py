"""Problem 6: which member of a duplicate group gives each field of the surviving record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.forests import connect
from weftline.llm.fusion import boilerplate, chosen, own_text
from weftline.operators.instants import to_moments
from weftline.operators.materialize import materialize
from weftline.sources.tables import table


def fused(spark: SparkSession, data_dir: str) -> DataFrame:
    """(group, field, row_id) for the groups tied by duplicate_of_article_id."""
    articles = table(spark, data_dir, "articles")
    pub = table(spark, data_dir, "publishers")
    groups = materialize(connect(articles.filter("duplicate_of_article_id IS NOT NULL"), "id", "duplicate_of_article_id"), "groups")
    cols = articles.select("id", "source_domain", "published_at", "excerpt", F.unix_micros("retrieved_at").alias("_ingested"))
    members = materialize(cols.join(groups.select(F.col("node").alias("id"), F.col("root").alias("group")), "id").dropDuplicates(["id"]), "members")
    moments = to_moments(members.select("id", "group", "source_domain", "published_at", "_ingested"), "published_at", "source_domain", pub, "_ingested")
    times = moments.filter("utc_us IS NOT NULL").select("group", F.lit("published_at").alias("field"), F.col("source_domain").alias("source"), F.col("id").alias("row_id"), F.col("utc_us").cast("string").alias("value"), F.col("utc_us").alias("preference"))
    domains = members.join(pub.select("source_domain", "trust_rank"), "source_domain").select("group", F.lit("source_domain").alias("field"), F.col("source_domain").alias("source"), F.col("id").alias("row_id"), F.col("source_domain").alias("value"), (-F.col("trust_rank")).alias("preference"))
    tied = articles.select("id", "excerpt").join(groups.select(F.col("node").alias("id"), F.col("root").alias("group")), "id", "left")
    own = own_text(members, "id", "excerpt", boilerplate(tied, "excerpt", group="group"))
    texts = members.join(own, "id").select("group", F.lit("excerpt").alias("field"), F.col("source_domain").alias("source"), F.col("id").alias("row_id"), F.col("own_key").alias("value"), F.col("own").alias("preference"))
    return chosen(materialize(times.unionByName(domains).unionByName(texts), "claims"))


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(group_id, field, article_id): the member that gives each field."""
    return fused(spark, data_dir).select(F.col("group").alias("group_id"), "field", F.col("row_id").alias("article_id"))


QUERIES = {"p6_found": p6_found}
ORACLE: dict[str, str] = {}
