"""Problem 3: articles whose words differ by small edits only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.forests import connect
from weftline.llm.near import near_pairs
from weftline.operators.materialize import materialize
from weftline.sources.tables import table

THRESHOLD = 0.7


def _parts(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    articles = table(spark, data_dir, "articles").select("id", "title", "excerpt")
    return near_pairs(articles, "id", ["title", "excerpt"], THRESHOLD)


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(article_a_id, article_b_id) of each pair of articles that share 70 percent of their words. TESTDATA asks for every pair, so
    pairs of classes and of copies are expanded at the very end."""
    membership, pairs = _parts(spark, data_dir)
    m = membership
    across = pairs.join(m.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    copies = m.alias("l").join(m.alias("r"), "class").filter("l.id < r.id").select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    return across.unionByName(copies).select(F.least("x", "y").alias("article_a_id"), F.greatest("x", "y").alias("article_b_id"))


def p3_groups(spark: SparkSession, data_dir: str) -> DataFrame:
    """(article_id, group_id, copies, links): every article with the group of near-duplicates that it is in, the number of articles with the same words, and
    the number of different texts that it is linked to."""
    membership, pairs = _parts(spark, data_dir)
    pairs = materialize(pairs, "pairs")
    roots = connect(pairs, "a", "b").select(F.col("node").alias("class"), "root")
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    copies = membership.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    out = membership.join(copies, "class").join(roots, "class", "left").join(links, "class", "left")
    return out.select(F.col("id").alias("article_id"), F.coalesce("root", "class").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLE: dict[str, str] = {}
