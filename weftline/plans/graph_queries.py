"""Queries on the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.claims import claim_evidence, entity_names
from weftline.operators.graphs import article_graph, components, graph_stats as stats_of, pagerank
from weftline.operators.materialize import materialize
from weftline.plans.relational import _members
from weftline.plans.story_queries import _claims
from weftline.plans.texts import A, articles
from weftline.sources.tables import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return article_graph(articles(spark, d, "source_domain", "topic", "is_near_duplicate", "duplicate_of_article_id"))


ENTITIES = 8  # of an article


def evidence_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph: besides articles, sources and topics also stories (a label's similarity is 1), entities and claims."""

    a = materialize(articles(spark, d, "title", "excerpt", "source_domain", "topic", "is_near_duplicate", "duplicate_of_article_id"), "articles")
    mentions = a.select(F.col("id").alias("article_id"), F.explode(entity_names(T.body_text(F.col("title"), F.col("excerpt")), ENTITIES)).alias("entity"))
    members = _members(spark, d).select(F.col("id").alias("article_id"), F.col("story_label").alias("story"), F.lit(1.0).alias("similarity"))
    said = claim_evidence(_claims(spark, d), "story").withColumn("claim", F.concat_ws("/", F.col("story").cast("string"), F.col("claim_hash").cast("string")))
    return article_graph(a, members, mentions=mentions, evidence=said)


def evidence_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats_of(evidence_graph_edges(spark, d))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def graph_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats_of(_edges(spark, d))


def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def story_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of all reviewed pairs, whatever the verdict."""
    p = table(spark, d, "story_pairs").select("article_a_id", "article_b_id")
    return components(p, "article_a_id", "article_b_id").select(F.col("node").alias("article_id"), "component")


def pagerank_fixed_iter(spark: SparkSession, d: str) -> DataFrame:
    """Five rounds from the articles of one topic over the domain and topic graph."""
    e = materialize(_edges(spark, d), "edges")
    seeds = articles(spark, d, "topic").filter("topic = 'ai_models'").select(F.concat(F.lit("article:"), F.col("id").cast("string")).alias("node"), F.lit(1.0).alias("weight"))
    rank, _ = pagerank(e, seeds, tolerance=0.0, max_rounds=5)
    return rank.select("node", F.round("mass", 9).alias("mass"))


def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """(node, mass, rounds, converged) from the topics over the whole graph, at the operator's damping and tolerance."""
    e = materialize(evidence_graph_edges(spark, d), "edges")
    seeds = e.filter(F.col("src").startswith("topic:")).select(F.col("src").alias("node"), F.lit(1.0).alias("weight")).distinct()
    rank, rounds = pagerank(e, seeds, max_rounds=1000)
    return rank.select("node", "mass", F.lit(rounds).alias("rounds"), F.lit(rounds < 1000).alias("converged"))


QUERIES = {f.__name__: f for f in (graph_edges, evidence_graph_edges, evidence_graph_stats, graph_kinds, graph_stats, degree_histogram, story_components, pagerank_fixed_iter, pagerank_converged)}

_E = f"""a AS {A}, o AS (SELECT 'article:' || id AS src, 'source:' || lower(coalesce(source_domain, 'unknown')) AS dst, 'published_by' AS kind, 1.0::DOUBLE AS weight, 1 AS p FROM a
  UNION ALL SELECT 'article:' || id, 'article:' || duplicate_of_article_id, 'near_duplicate_of', 0.2::DOUBLE, 2 FROM a WHERE is_near_duplicate AND duplicate_of_article_id IS NOT NULL
  UNION ALL SELECT 'article:' || id, 'topic:' || lower(topic), 'about', 1.0::DOUBLE, 3 FROM a WHERE topic IS NOT NULL),
  b AS (SELECT src, dst, kind, weight, p FROM o UNION ALL SELECT dst, src, kind, weight, p FROM o),
  e AS (SELECT src, dst, arg_max(kind, p) AS kind, arg_max(weight, p) AS weight FROM b GROUP BY src, dst)"""


def _step(n: int) -> str:
    return f"r{n} AS (SELECT b.node, 0.85::DOUBLE * coalesce(f, 0) + 0.15::DOUBLE * b.mass AS mass FROM r0 b LEFT JOIN (SELECT dst, sum(mass * w) AS f FROM r{n - 1} JOIN t ON node = src GROUP BY dst) x ON x.dst = b.node)"


ORACLE = {
    "graph_edges": f"WITH {_E} SELECT src, dst, kind, weight FROM e",
    "graph_kinds": f"WITH {_E} SELECT kind, count(*) AS edges, round(sum(weight), 6) AS weight FROM e GROUP BY kind",
    "graph_stats": f"WITH {_E}, n AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node) SELECT count(*) AS nodes, (sum(degree) // 2)::BIGINT AS edges, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM n",
    "degree_histogram": f"WITH {_E} SELECT degree, count(*) AS nodes FROM (SELECT src, count(*) AS degree FROM e GROUP BY src) GROUP BY degree",
    "story_components": """WITH RECURSIVE l AS (SELECT article_a_id AS a, article_b_id AS b FROM story_pairs WHERE article_a_id IS NOT NULL AND article_b_id IS NOT NULL UNION SELECT article_b_id, article_a_id FROM story_pairs WHERE article_a_id IS NOT NULL AND article_b_id IS NOT NULL),
      r(node, low) AS (SELECT a, a FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node)
      SELECT node AS article_id, min(low) AS component FROM r GROUP BY node""",
    "pagerank_fixed_iter": f"""WITH {_E}, t AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM e), n AS (SELECT DISTINCT src AS node FROM e),
      s AS (SELECT 'article:' || id AS node FROM a WHERE topic = 'ai_models'), r0 AS (SELECT n.node, CASE WHEN s.node IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (SELECT count(*) FROM s) END AS mass FROM n LEFT JOIN s USING (node)),
      {_step(1)}, {_step(2)}, {_step(3)}, {_step(4)}, {_step(5)} SELECT node, round(mass, 9) AS mass FROM r5""",
}
