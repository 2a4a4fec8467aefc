"""Queries on claims, timelines, summaries and story assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.claims import claim_heads, entity_names, extract_claims, find_conflicts, group_claims
from weftline.operators.materialize import materialize
from weftline.operators.stories import assign_stories, summarize, timeline
from weftline.plans.relational import _members
from weftline.plans.texts import articles


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Story members with their text."""
    a = articles(spark, d, "title", "excerpt").select("id", T.body_text(F.col("title"), F.col("excerpt")).alias("body"))
    m = _members(spark, d).select("id", "story_label", "source_domain", F.unix_micros("retrieved_at").alias("at"), F.coalesce("is_near_duplicate", F.lit(False)).alias("is_near_duplicate"))
    return m.join(a, "id").withColumnRenamed("story_label", "story")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return materialize(extract_claims(_bodies(spark, d).withColumnRenamed("id", "article_id"), "body").drop("body"), "claims")


def claims_extract(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select("article_id", "start", "stop", "claim_hash", "predicate", "confidence", "negated", "hedged")


def claim_groups(spark: SparkSession, d: str) -> DataFrame:
    return group_claims(_claims(spark, d), "story")


def claim_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return find_conflicts(_claims(spark, d), "story")


def claim_stances(spark: SparkSession, d: str) -> DataFrame:
    """What each claim's occurrence does: where its group contradicts itself it disputes, or is unclear if negated; else it supports with other sources or reports alone."""
    c = _claims(spark, d)
    g = group_claims(c, "story").select("story", F.col("claim_hash").alias("head"), "domains", (F.col("status") == "unclear").alias("_split"))
    e = claim_heads(c, "story").join(g, ["story", "head"])
    stance = F.when(F.col("_split"), F.when(F.col("negated"), "unclear").otherwise("disputes")).when((F.col("domains") > 1) & ~F.col("is_near_duplicate"), "supports").otherwise("reports")
    return e.groupBy(stance.alias("stance")).agg(F.count(F.lit(1)).alias("occurrences"))


def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entities of more than one article, from title and excerpt."""
    a = articles(spark, d, "title", "excerpt").select("id", T.body_text(F.col("title"), F.col("excerpt")).alias("body"))
    return a.select("id", F.explode(entity_names(F.col("body"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("articles")).filter("articles > 1")


def timeline_novelty(spark: SparkSession, d: str) -> DataFrame:
    return timeline(_bodies(spark, d))


def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    return summarize(_bodies(spark, d))


def citation_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Statements whose cited article is among the story's own: anti-join of those that don't resolve."""
    b = materialize(_bodies(spark, d), "bodies")
    s = materialize(summarize(b), "summary")
    lost = s.join(b.select("story", F.col("id").alias("article_id")), ["story", "article_id"], "left_anti").count()
    return s.agg(F.count(F.lit(1)).alias("statements"), F.countDistinct("story").alias("stories")).withColumn("unresolved", F.lit(lost))


def story_assign_online(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d, "title", "excerpt", "topic", "retrieved_at", "is_near_duplicate", "duplicate_of_article_id")
    return assign_stories(a.select("id", "title", T.body_text(F.col("title"), F.col("excerpt")).alias("body"), F.unix_micros("retrieved_at").alias("at"), "topic", "is_near_duplicate", F.col("duplicate_of_article_id").alias("duplicate_of")))


QUERIES = {f.__name__: f for f in (claims_extract, claim_groups, claim_conflicts, claim_stances, entity_counts, timeline_novelty, extractive_summary, citation_coverage, story_assign_online)}
ORACLE: dict[str, str] = {}
