"""Typed evidence graph: edges, statistics, components, personalised PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.materialize import materialize


def article_graph(articles: DataFrame, memberships: DataFrame | None = None, duplicate_weight: float = 0.2, mentions: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, weight) in both directions from articles (id, source_domain, topic, is_near_duplicate,
    duplicate_of_article_id), memberships (article_id, story, similarity), mentions (article_id, entity) and evidence (article_id, claim, disputes,
    confidence). Of several edges between two nodes the last kind written wins, in the order published_by, near_duplicate_of, about, belongs_to,
    mentions, and of evidence the last with the highest confidence."""
    node = lambda kind, c: F.concat(F.lit(kind + ":"), c.cast("string"))
    a = node("article", F.col("id"))
    parts = [
        articles.select(a.alias("src"), node("source", F.lower(F.coalesce("source_domain", F.lit("unknown")))).alias("dst"), F.lit("published_by").alias("kind"), F.lit(1.0).alias("weight"), F.lit(1).alias("p")),
        articles.filter(F.col("is_near_duplicate") & F.col("duplicate_of_article_id").isNotNull()).select(a.alias("src"), node("article", F.col("duplicate_of_article_id")).alias("dst"), F.lit("near_duplicate_of").alias("kind"), F.lit(duplicate_weight).alias("weight"), F.lit(2).alias("p")),
        articles.filter(F.col("topic").isNotNull()).select(a.alias("src"), node("topic", F.lower("topic")).alias("dst"), F.lit("about").alias("kind"), F.lit(1.0).alias("weight"), F.lit(3).alias("p")),
    ]
    if memberships is not None:
        parts.append(memberships.select(node("article", F.col("article_id")).alias("src"), node("story", F.col("story")).alias("dst"), F.lit("belongs_to").alias("kind"), F.greatest(F.lit(0.05), F.col("similarity")).alias("weight"), F.lit(4).alias("p")))
    if mentions is not None:
        parts.append(mentions.select(node("article", F.col("article_id")).alias("src"), node("entity", F.col("entity")).alias("dst"), F.lit("mentions").alias("kind"), F.lit(1.0).alias("weight"), F.lit(5).alias("p")))
    if evidence is not None:
        sure = F.when(F.col("confidence") > 0, F.col("confidence")).otherwise(0.5)
        said = evidence.groupBy("article_id", "claim").agg(F.max(F.struct(F.greatest(F.lit(0.05), sure).alias("w"), "disputes")).alias("e"))
        parts.append(said.select(node("article", F.col("article_id")).alias("src"), node("claim", F.col("claim")).alias("dst"), F.when(F.col("e.disputes"), "disputes").otherwise("reports").alias("kind"), F.col("e.w").alias("weight"), F.lit(6).alias("p")))
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "weight", "p"))
    return both.groupBy("src", "dst").agg(F.max_by(F.struct("kind", "weight"), F.col("p")).alias("e")).select("src", "dst", F.col("e.kind").alias("kind"), F.col("e.weight").alias("weight"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node of each component. Alternating large-star and small-star steps (Kiveris et al. 2014): a hub's
    neighbours all move to its smallest neighbour at once, so rounds grow with the logarithm of the nodes. Each round is two aggregations and joins
    on the edges, written to the shared folder."""
    e = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = e.select("u").unionByName(e.select(F.col("v").alias("u"))).distinct()
    e = materialize(e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    nodes = materialize(nodes, "nodes")
    before = None
    while True:
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("a"), "m").unionByName(small.select(F.col("u").alias("a"), "m")).filter("a <> m").select(F.col("m").alias("u"), F.col("a").alias("v")).distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("v").alias("node"), F.col("u").alias("root")), nodes["u"] == F.col("node"), "left").select(nodes["u"].alias("node"), F.coalesce("root", nodes["u"]).alias("component"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and largest degree (in and out)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return ends.agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))


def pagerank(edges: DataFrame, restart: DataFrame, damping: float = 0.85, tolerance: float = 1e-8, max_rounds: int = 100, cut_every: int = 5) -> tuple[DataFrame, int]:
    """((node, mass), rounds): power iteration of personalised PageRank. restart (node, weight) is scaled to one; the mass of
    dangling nodes goes to it. Stops when masses move less than tolerance in total in one round, which is measured every cut_every rounds. Pre-aggregation on dst keeps hubs harmless;
    lineage is cut at the same rounds."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    step = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "transitions")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    total = restart.join(nodes, "node").agg(F.sum("weight")).first()[0] or 0.0
    if total:
        base = nodes.join(restart.groupBy("node").agg(F.sum("weight").alias("w")), "node", "left").select("node", (F.coalesce("w", F.lit(0.0)) / total).alias("r"))
    else:
        n = max(nodes.count(), 1)
        base = nodes.select("node", F.lit(1.0 / n).alias("r"))
    base = materialize(base.join(out.select(F.col("src").alias("node"), F.lit(True).alias("has")), "node", "left").select("node", "r", F.col("has").isNull().alias("dangling")), "restart")
    rank = base.select("node", F.col("r").alias("mass"))
    hanging = not base.filter("dangling").isEmpty()
    for r in range(1, max_rounds + 1):
        hung = rank.join(base.filter("dangling").select("node"), "node", "left_semi").agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0] if hanging else 0.0
        flow = rank.join(step, rank["node"] == step["src"]).groupBy("dst").agg(F.sum(F.col("mass") * F.col("p")).alias("f"))
        before = rank
        rank = base.join(flow, base["node"] == flow["dst"], "left").select("node", (damping * (F.coalesce("f", F.lit(0.0)) + hung * F.col("r")) + (1 - damping) * F.col("r")).alias("mass"))
        if tolerance > 0 and r % cut_every == cut_every - 1:
            rank = materialize(rank, "mass")  # the next round's movement is measured from here
        elif r % cut_every == 0:
            rank = materialize(rank, "mass")
            if tolerance > 0:
                moved = rank.join(before.select("node", F.col("mass").alias("old")), "node").agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0] or 0.0
                if moved < tolerance:
                    return rank, r
    return rank, max_rounds
