"""Problem 2: one group identifier for all articles that reviewers' verdicts link."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.forests import connect
from weftline.sources.tables import table

# What reviewers type for yes.
YES = ["yes", "y", "true", "t", "1", "same", "ja", "si", "sí", "oui", "x", "ok", "1.0", "yes.", "+", "match", "duplicate", "agree", "✓", "✔"]


def yes_pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    verdict = F.lower(F.regexp_replace(F.col("same_story"), r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}.!]+$", ""))
    return table(spark, data_dir, "story_pairs").filter(verdict.isin(YES)).select("article_a_id", "article_b_id")


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(article_id, group_id) of each article that a yes links to another."""
    return connect(yes_pairs(spark, data_dir), "article_a_id", "article_b_id").select(F.col("node").alias("article_id"), F.col("root").alias("group_id"))


def p2_group_sizes(spark: SparkSession, data_dir: str) -> DataFrame:
    """(copies, groups): how many groups have how many members."""
    return p2_found(spark, data_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("groups"))


QUERIES = {"p2_found": p2_found, "p2_group_sizes": p2_group_sizes}

_GROUPS = f"""WITH RECURSIVE e AS (
  SELECT article_a_id a, article_b_id b FROM story_pairs
  WHERE lower(trim(rtrim(trim(same_story, E' \\t\\r\\n'), '.!'), E' \\t\\r\\n')) IN ({", ".join("'" + y + "'" for y in YES)})
    AND article_a_id IS NOT NULL AND article_b_id IS NOT NULL AND article_a_id <> article_b_id),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
g AS (SELECT node AS article_id, min(reach) AS group_id FROM r GROUP BY node)
"""
ORACLE = {
    "p2_found": _GROUPS + "SELECT article_id, group_id FROM g",
    "p2_group_sizes": _GROUPS + "SELECT copies, count(*) AS groups FROM (SELECT group_id, count(*) AS copies FROM g GROUP BY group_id) GROUP BY copies",
}
