"""Ranking and clustering metrics as aggregations over long tables; bootstrap with hashed draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.hashing import hash64


def rank_metrics(hits: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per judged query: precision@k (over k even if fewer came), recall@k, reciprocal rank, nDCG@k.

    hits (query_id, doc_id, rank), judged (query_id, doc_id, relevance > 0)."""
    n = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    ideal = judged.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))).filter(F.col("i") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(F.col("relevance") / F.log2(F.col("i") + 1.0)).alias("ideal"))
    met = hits.join(judged, ["query_id", "doc_id"])
    got = met.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, F.col("relevance") / F.log2(F.col("rank") + 1.0))).alias("dcg")
    )
    out = n.join(ideal, "query_id").join(got, "query_id", "left")
    hit = F.coalesce("hits", F.lit(0))
    return out.select("query_id", (hit / k).alias("precision"), (hit / F.col("relevant")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def topk_overlap(base: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """Per query of base the share of its k best that the other has among its k best."""
    b = base.filter(F.col("rank") <= k).select("query_id", "doc_id")
    o = other.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return b.join(o, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("overlap"))


def contingency(items: DataFrame, truth: str, pred: str) -> DataFrame:
    """(t, p, n, nt, np): cell counts with their margins. Nulls on either side leave the item out. One pass over the items; the rest works on cells."""
    cells = items.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = cells.groupBy("t").agg(F.sum("n").alias("nt"))
    p = cells.groupBy("p").agg(F.sum("n").alias("np"))
    return cells.join(t, "t").join(p, "p")


def _pairs(x):
    return x * (x - 1) / 2


def clustering_metrics(items: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: pairwise precision, recall and F1, B-cubed, adjusted Rand index, fragmentation and merge rate."""
    c = contingency(items, truth, pred)
    cell = c.agg(F.sum(_pairs(F.col("n"))).alias("both"), F.sum(F.col("n") * F.col("n") / F.col("np")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("nt")).alias("br"), F.sum("n").alias("total"))
    t = c.groupBy("t").agg(F.first("nt").alias("m"), F.count(F.lit(1)).alias("parts")).agg(F.sum(_pairs(F.col("m"))).alias("tp"), F.avg(F.when(F.col("parts") > 1, 1.0).otherwise(0.0)).alias("fragmentation"))
    p = c.groupBy("p").agg(F.first("np").alias("m"), F.count(F.lit(1)).alias("parts")).agg(F.sum(_pairs(F.col("m"))).alias("pp"), F.avg(F.when(F.col("parts") > 1, 1.0).otherwise(0.0)).alias("merge"))
    one = cell.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(p))  # three tables of one row each
    f1 = lambda a, b: F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)
    pr = F.when(F.col("pp") > 0, F.col("both") / F.col("pp")).otherwise(0.0)
    rc = F.when(F.col("tp") > 0, F.col("both") / F.col("tp")).otherwise(0.0)
    bp, br = F.col("bp") / F.col("total"), F.col("br") / F.col("total")
    expected = F.when(F.col("total") > 1, F.col("tp") * F.col("pp") / _pairs(F.col("total"))).otherwise(0.0)
    top = (F.col("tp") + F.col("pp")) / 2
    ari = F.when(F.col("total") <= 1, 0.0).when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected))
    return one.select(pr.alias("precision"), rc.alias("recall"), f1(pr, rc).alias("f1"), bp.alias("b3_precision"), br.alias("b3_recall"), f1(bp, br).alias("b3_f1"), ari.alias("ari"), "fragmentation", "merge")


def bootstrap_ci(values: DataFrame, value: str, key: str, draws: int = 2000, confidence: float = 0.95, seed: int = 549) -> DataFrame:
    """(mean, lo, hi, n): percentile bootstrap of the mean. Each draw gives every row a Poisson-like weight by hash of seed, draw and key (0 to 3
    times), so a draw is an aggregation and no row list leaves its task; weights are those of a Poisson(1) cut at its quantiles."""
    rows = values.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(key).cast("string").alias("k"))
    u = F.col("u") / F.lit(4294967296.0)
    weight = F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.9197, 2).when(u < 0.98101, 3).otherwise(4)
    spread = rows.select("v", "k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("u", F.pmod(hash64(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("k"))), F.lit(4294967296)))
    means = spread.groupBy("draw").agg((F.sum(F.col("v") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("m"))
    tail = (1 - confidence) / 2
    ci = means.agg(F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi"))
    return rows.agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(ci)).select("mean", "lo", "hi", "n")
