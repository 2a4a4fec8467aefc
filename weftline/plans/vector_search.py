"""Queries on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.vectors import cosine, l2_normalize, norm
from weftline.operators.materialize import materialize
from weftline.operators.vectors import IvfIndex, cosine_topk, gaussian_matrix, hashed_pairs, project, sparse_signs, svd_components
from weftline.sources.tables import table

K = 10


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vec_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return cosine_topk(_docs(spark, d), _queries(spark, d), "vec_id", "embedding", K).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vec_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter comes before scoring, so every query still gets k rows."""
    return cosine_topk(_docs(spark, d).filter(F.col("label") < 5), _queries(spark, d), "vec_id", "embedding", 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def vec_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return _docs(spark, d).select("vec_id", F.round(norm(v), 6).alias("norm"), F.round(F.get(l2_normalize(v), F.lit(0)), 6).alias("first"))


def rp_project_sparse(spark: SparkSession, d: str) -> DataFrame:
    p = project(_docs(spark, d), "embedding", sparse_signs(64, 8))
    return p.select("vec_id", F.posexplode("embedding").alias("component", "value")).select("vec_id", "component", (F.round("value", 6) + 0.0).alias("value"))


def rp_project_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return project(_docs(spark, d), "embedding", gaussian_matrix(64, 16)).select("vec_id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("norm"))


def svd_explained(spark: SparkSession, d: str) -> DataFrame:
    """Norms that survive projection to 16 leading directions."""
    p = project(_docs(spark, d), "embedding", svd_components(_docs(spark, d), "embedding", 16))
    return p.agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg(norm(F.col("embedding"))), 6).alias("mean_norm"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    v = _docs(spark, d)
    p = hashed_pairs(v, "vec_id")
    return p.join(v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), "a").join(v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb")), "b")


def cosine_distortion(spark: SparkSession, d: str) -> DataFrame:
    """How far cosines move under the sparse projection, over a fixed sample of pairs."""
    p = materialize(_pairs(spark, d), "pairs")
    r = sparse_signs(64, 16)
    moved = project(project(p.withColumn("pa", F.col("va")).withColumn("pb", F.col("vb")), "pa", r), "pb", r)
    err = F.abs(cosine(F.col("pa"), F.col("pb")) - cosine(F.col("va"), F.col("vb")))
    return moved.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(err), 6).alias("mean_error"), F.round(F.percentile(err, 0.95), 6).alias("p95_error"))


def distance_distortion(spark: SparkSession, d: str) -> DataFrame:
    p = materialize(_pairs(spark, d), "pairs")
    diff = p.select("a", "b", F.zip_with(F.col("va").cast("array<double>"), F.col("vb").cast("array<double>"), lambda x, y: x - y).alias("v"))
    both = project(diff.withColumn("p", F.col("v")), "p", sparse_signs(64, 16))
    ratio = F.abs(norm(F.col("p")) / norm(F.col("v")) - 1)
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(ratio), 6).alias("mean_error"), F.round(F.max(ratio), 6).alias("max_error"))


def _ivf(spark: SparkSession, d: str, parts: int = 0) -> tuple[IvfIndex, DataFrame]:
    ivf = IvfIndex(cells=16, parts=parts).fit(_docs(spark, d), "vec_id", "embedding")
    return ivf, materialize(ivf.index(_docs(spark, d), "vec_id", "embedding"), "ivf")


def ann_full_probe(spark: SparkSession, d: str) -> DataFrame:
    """Probing every cell gives the exact ranking."""
    ivf, index = _ivf(spark, d)
    return ivf.search(index, _queries(spark, d), "query_id", "embedding", K, 16).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _recall(spark: SparkSession, d: str, parts: int, probes: int) -> DataFrame:
    ivf, index = _ivf(spark, d, parts)
    found = ivf.search(index, _queries(spark, d), "query_id", "embedding", 5 * K if parts else K, probes)
    if parts:  # codes rank roughly: the best five times k are ranked again by their own vectors
        whole = found.join(_queries(spark, d).withColumnRenamed("embedding", "vq"), "query_id").join(_docs(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vd")), "doc_id")
        again = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(cosine(F.col("vq"), F.col("vd"))), "doc_id"))
        found = whole.select("query_id", "doc_id", again.alias("again")).filter(F.col("again") <= K)
    exact = cosine_topk(_docs(spark, d), _queries(spark, d), "vec_id", "embedding", K, exclude_self=False).select("query_id", "doc_id")
    return exact.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


def ann_flat_recall(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, 0, 14)


def ann_pq_recall(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, 32, 16)


def ivf_cells(spark: SparkSession, d: str) -> DataFrame:
    _, index = _ivf(spark, d)
    return index.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("cells"), F.max("rows").alias("largest"))


QUERIES = {f.__name__: f for f in (vec_cosine_topk, vec_topk_filtered, vec_norms, rp_project_sparse, rp_project_gaussian, svd_explained, cosine_distortion, distance_distortion, ann_full_probe, ann_flat_recall, ann_pq_recall, ivf_cells)}

E_ = "(SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
COS = "(list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(d.v, d.v)))"


def topk_sql(k: int, where: str = "true", self_: str = "AND q.vec_id <> d.vec_id") -> str:
    return f"""SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {COS} AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, d.vec_id) AS rank FROM {E_} q, {E_} d WHERE q.vec_id % 20 = 0 {self_} AND {where}) WHERE rank <= {k}"""


def _signs(j: str, dim: int, n: int) -> str:
    u = f"(('0x' || substr(sha256('549:' || (i - 1) || ':' || {j}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"
    return f"sqrt({dim ** 0.5!r}::DOUBLE / {n}) * CASE WHEN {u} < 1 / (2 * {dim ** 0.5!r}::DOUBLE) THEN 1 WHEN {u} < 1 / {dim ** 0.5!r}::DOUBLE THEN -1 ELSE 0 END"


_R16 = f"(SELECT i, j, {_signs('j', 64, 16)} AS r FROM (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(0, 16)) AS j))"
_PAIRS = """h AS (SELECT vec_id AS a, ('0x' || substr(sha256('pair:' || vec_id), 1, 16))::UBIGINT AS u FROM embeddings),
  s AS (SELECT a, u, (CASE WHEN u::HUGEINT >= 9223372036854775808 THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END) AS g, u >> 56 AS bk FROM h),
  w AS (SELECT a, lead(a, 1) OVER (PARTITION BY bk ORDER BY g, a) AS b1, lead(a, 2) OVER (PARTITION BY bk ORDER BY g, a) AS b2 FROM s),
  p AS (SELECT a, b1 AS b FROM w WHERE b1 IS NOT NULL UNION ALL SELECT a, b2 FROM w WHERE b2 IS NOT NULL)"""
ORACLE = {
    "vec_cosine_topk": topk_sql(K),
    "vec_topk_filtered": topk_sql(5, "d.label < 5"),
    "vec_norms": f"SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM {E_}",
    "rp_project_sparse": f"SELECT vec_id, j::INT AS component, round(sum(x * r), 6) + 0.0 AS value FROM (SELECT vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM {E_}) JOIN (SELECT i, j, {_signs('j', 64, 8)} AS r FROM (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(0, 8)) AS j)) USING (i) GROUP BY vec_id, j",
    "cosine_distortion": f"""WITH {_PAIRS}, m AS (SELECT vec_id, list(y ORDER BY j) AS v FROM (SELECT vec_id, j, sum(x * r) AS y FROM (SELECT vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM {E_}) JOIN {_R16} USING (i) GROUP BY ALL) GROUP BY vec_id),
      c AS (SELECT abs(list_cosine_similarity(x.v, y.v) - list_cosine_similarity(e.v, f.v)) AS err FROM p JOIN m x ON p.a = x.vec_id JOIN m y ON p.b = y.vec_id JOIN {E_} e ON p.a = e.vec_id JOIN {E_} f ON p.b = f.vec_id)
      SELECT count(*) AS pairs, round(avg(err), 6) AS mean_error, round(quantile_cont(err, 0.95), 6) AS p95_error FROM c""",
    "distance_distortion": f"""WITH {_PAIRS}, t AS (SELECT a, b, unnest(e.v) - unnest(f.v) AS x, unnest(range(1, 65)) AS i FROM p JOIN {E_} e ON p.a = e.vec_id JOIN {E_} f ON p.b = f.vec_id),
      o AS (SELECT a, b, sqrt(sum(x * x)) AS n FROM t GROUP BY a, b), y AS (SELECT a, b, sqrt(sum(z * z)) AS n FROM (SELECT a, b, j, sum(x * r) AS z FROM t JOIN {_R16} USING (i) GROUP BY ALL) GROUP BY a, b)
      SELECT count(*) AS pairs, round(avg(abs(y.n / o.n - 1)), 6) AS mean_error, round(max(abs(y.n / o.n - 1)), 6) AS max_error FROM o JOIN y USING (a, b)""",
    "ann_full_probe": topk_sql(K, self_=""),
}
