"""Queries on lexical retrieval, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.evaluation import bootstrap_ci, clustering_metrics, rank_metrics, topk_overlap
from weftline.operators.lexical import B, K1, TITLE_WEIGHT, blend, bm25_topk, signal_rerank, tfidf_topk
from weftline.operators.materialize import materialize
from weftline.plans.graph_queries import ORACLE as GRAPH_SQL, pagerank_fixed_iter
from weftline.plans.texts import A, articles, quoted, tok
from weftline.plans.vector_search import topk_sql, vec_cosine_topk, vec_topk_filtered
from weftline.sources.tables import table

AS_OF_US = 1_790_000_000_000_000


def _queries(spark: SparkSession, d: str) -> DataFrame:
    q = articles(spark, d, "title").filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), T.query_words(F.col("title")).alias("w"))
    return q.filter(F.size("w") >= 4).select("query_id", F.array_join("w", " ").alias("query"))


def _tfidf(spark: SparkSession, d: str, k: int) -> DataFrame:
    a = articles(spark, d, "title", "excerpt")
    return tfidf_topk(a, "id", T.body_text(F.col("title"), F.col("excerpt")), _queries(spark, d), k)


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    return bm25_topk(articles(spark, d, "title", "excerpt"), "id", F.col("title"), F.col("excerpt"), _queries(spark, d), k)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_tfidf(spark, d, 10))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_bm25(spark, d, 10))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    docs = articles(spark, d, "retrieved_at", "is_near_duplicate").select(F.col("id").alias("doc_id"), F.unix_micros("retrieved_at").alias("published_us"), "is_near_duplicate")
    return signal_rerank(materialize(_bm25(spark, d, 40), "hits"), docs, AS_OF_US, half_life_hours=2400.0)


def signal_reranked(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_signals(spark, d)).filter(F.col("rank") <= 10)


def pagerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """Hits blended with the mass that five rounds of PageRank from one topic's articles give each article (the walk of pagerank_fixed_iter)."""
    mass = pagerank_fixed_iter(spark, d).filter(F.col("node").startswith("article:")).select(F.substring_index("node", ":", -1).cast("long").alias("doc_id"), "mass")
    return _shown(blend(materialize(_bm25(spark, d, 40), "hits"), materialize(mass, "mass"))).filter(F.col("rank") <= 10)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "label")
    return q.join(e, "label").filter(F.col("query_id") != F.col("vec_id")).select("query_id", F.col("vec_id").alias("doc_id"), F.lit(1.0).alias("relevance"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return materialize(rank_metrics(vec_cosine_topk(spark, d), _judged(spark, d), 10), "metrics")


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")])


def ranking_macro(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")])


def filtered_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = topk_overlap(vec_cosine_topk(spark, d), vec_topk_filtered(spark, d), 5)
    return o.select("query_id", F.round("overlap", 6).alias("overlap"))


def ndcg_interval(spark: SparkSession, d: str) -> DataFrame:
    b = bootstrap_ci(_metrics(spark, d), "ndcg", "query_id")
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "n")


def paired_interval(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap of the difference of two measures of the same queries."""
    diff = _metrics(spark, d).select("query_id", (F.col("ndcg") - F.col("precision")).alias("delta"))
    b = bootstrap_ci(diff, "delta", "query_id")
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")], "n", ((F.col("lo") <= 0) & (F.col("hi") >= 0)).alias("crosses_zero"))


def clustering_quality(spark: SparkSession, d: str) -> DataFrame:
    m = clustering_metrics(table(spark, d, "documents").select("topic", "source"), "topic", "source")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


QUERIES = {f.__name__: f for f in (tfidf_search, bm25_search, signal_reranked, pagerank_blend, ranking_metrics, ranking_macro, filtered_overlap, ndcg_interval, paired_interval, clustering_quality)}

_STOP = quoted(T.QUERY_STOP)
_Q = f"q AS (SELECT id AS query_id, array_to_string(w, ' ') AS query FROM (SELECT id, list_filter({tok('title')}, lambda t: t NOT IN ({_STOP}))[1:7] AS w FROM {A} WHERE id % 20 = 0) WHERE len(w) >= 4)"
_BODY = "trim((CASE WHEN coalesce(title, '') = '' OR regexp_matches(title, '[.!?]$') THEN coalesce(title, '') ELSE title || '.' END) || ' ' || coalesce(excerpt, ''))"


def _grams(x: str) -> str:
    t = f"list_filter({tok(x)}, lambda t: t NOT IN ({_STOP}) AND length(t) > 1)"
    return f"(CASE WHEN len({t}) < 2 THEN {t} ELSE list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])) END)"


_TFIDF = f"""{_Q}, a AS {A}, n AS (SELECT count(*) AS n FROM a),
  p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT id AS doc_id, unnest({_grams('b')}) AS term FROM (SELECT id, {_BODY} AS b FROM a)) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM p JOIN f USING (term), n),
  u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
  qp AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_grams('query')}) AS term FROM q) GROUP BY ALL),
  qw AS (SELECT query_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM qp JOIN f USING (term), n),
  qu AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw),
  s AS (SELECT query_id, doc_id, sum(qu.w * u.w) AS score FROM qu JOIN u USING (term) GROUP BY ALL)"""
_BM25 = f"""{_Q}, a AS {A}, n AS (SELECT count(*) AS n FROM a),
  p AS (SELECT doc_id, term, sum(tf) AS tf FROM (SELECT id AS doc_id, unnest({tok('title')}) AS term, {TITLE_WEIGHT} ::DOUBLE AS tf FROM a UNION ALL SELECT id, unnest({tok('excerpt')}), 1.0::DOUBLE FROM a) GROUP BY ALL),
  l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), v AS (SELECT sum(dl) / (SELECT n FROM n) AS avg FROM l),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY term), qt AS (SELECT DISTINCT query_id, unnest({tok('query')}) AS term FROM q),
  s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * dl / avg))) AS score
    FROM qt JOIN f USING (term) JOIN p USING (term) JOIN l USING (doc_id), n, v GROUP BY ALL)"""


def _top(k: int, source: str = "s") -> str:
    return f"(SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM {source} QUALIFY rank <= {k})"


_SHOW = "SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM "
_M = f"""h AS ({topk_sql(10)}), e AS (SELECT vec_id, label FROM embeddings), j AS (SELECT x.vec_id AS query_id, y.vec_id AS doc_id FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0),
  r AS (SELECT query_id, count(*) AS relevant, (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 11)) AS i) WHERE i <= count(*)) AS ideal FROM j GROUP BY query_id),
  g AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM h JOIN j USING (query_id, doc_id) GROUP BY query_id),
  m AS (SELECT r.query_id, coalesce(hits, 0) / 10 AS precision, coalesce(hits, 0) / relevant AS recall, coalesce(1 / first, 0) AS rr, coalesce(dcg / ideal, 0) AS ndcg FROM
    (SELECT query_id, relevant, list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM (SELECT query_id, count(*) AS relevant FROM j GROUP BY query_id)) r LEFT JOIN g USING (query_id))"""
_M = _M.replace("""  r AS (SELECT query_id, count(*) AS relevant, (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 11)) AS i) WHERE i <= count(*)) AS ideal FROM j GROUP BY query_id),
""", "")


def _boot(source: str, value: str) -> str:
    u = "(('0x' || substr(sha256('549:' || draw || ':' || query_id), 9, 8))::UBIGINT / 4294967296.0::DOUBLE)"
    return f"""d AS (SELECT draw, sum({value} * k) / nullif(sum(k), 0) AS mean FROM (SELECT draw, {value}, CASE WHEN {u} < 0.36788 THEN 0 WHEN {u} < 0.73576 THEN 1 WHEN {u} < 0.9197 THEN 2 WHEN {u} < 0.98101 THEN 3 ELSE 4 END AS k
      FROM {source}, (SELECT unnest(range(1, 2001)) AS draw)) GROUP BY draw), o AS (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM d)"""


ORACLE = {
    "tfidf_search": f"WITH {_TFIDF} {_SHOW}{_top(10)}",
    "bm25_search": f"WITH {_BM25} {_SHOW}{_top(10)}",
    "signal_reranked": f"""WITH {_BM25}, c AS (SELECT t.query_id, t.doc_id, (0.75::DOUBLE * t.score + 0.25::DOUBLE * coalesce(pow(0.5::DOUBLE, greatest(0.0::DOUBLE, ({AS_OF_US} - epoch_us(a.retrieved_at)) / 3.6e9::DOUBLE) / 2400.0::DOUBLE), 1.0::DOUBLE)) * (CASE WHEN a.is_near_duplicate THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS score
      FROM {_top(40)} t JOIN a ON a.id = t.doc_id) {_SHOW}{_top(10, 'c')}""",
    "pagerank_blend": f"""WITH {_BM25}, k AS (SELECT substr(node, 9)::BIGINT AS doc_id, mass FROM ({GRAPH_SQL["pagerank_fixed_iter"]}) WHERE starts_with(node, 'article:')),
      x AS (SELECT query_id, doc_id, score, coalesce(mass, 0) AS m FROM {_top(40)} LEFT JOIN k USING (doc_id)), y AS (SELECT *, min(m) OVER (PARTITION BY query_id) AS lo, max(m) OVER (PARTITION BY query_id) AS hi FROM x),
      c AS (SELECT query_id, doc_id, 0.7::DOUBLE * score + 0.3::DOUBLE * ((m - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END) AS score FROM y) {_SHOW}{_top(10, 'c')}""",
    "ranking_metrics": f"WITH {_M} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM m",
    "ranking_macro": f"WITH {_M} SELECT count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM m",
    "filtered_overlap": f"WITH b AS ({topk_sql(5)}), o AS ({topk_sql(5, 'd.label < 5')}) SELECT b.query_id, round(avg(CASE WHEN o.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS overlap FROM b LEFT JOIN o ON b.query_id = o.query_id AND b.doc_id = o.doc_id GROUP BY b.query_id",
    "ndcg_interval": f"WITH {_M}, {_boot('m', 'ndcg')} SELECT round((SELECT avg(ndcg) FROM m), 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, (SELECT count(*) FROM m) AS n FROM o",
    "paired_interval": f"WITH {_M}, z AS (SELECT query_id, ndcg - precision AS delta FROM m), {_boot('z', 'delta')} SELECT round((SELECT avg(delta) FROM z), 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, (SELECT count(*) FROM z) AS n, lo <= 0 AND hi >= 0 AS crosses_zero FROM o",
    "clustering_quality": """WITH i AS (SELECT topic AS t, source AS p FROM documents WHERE topic IS NOT NULL AND source IS NOT NULL), c AS (SELECT t, p, count(*)::DOUBLE AS n FROM i GROUP BY t, p),
      a AS (SELECT t, sum(n) AS m, count(*) AS k FROM c GROUP BY t), b AS (SELECT p, sum(n) AS m, count(*) AS k FROM c GROUP BY p),
      s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS x, (SELECT sum(m * (m - 1) / 2) FROM a) AS tp, (SELECT sum(m * (m - 1) / 2) FROM b) AS pp, (SELECT sum(n) FROM c) AS n,
        (SELECT sum(c.n * c.n / b.m) FROM c JOIN b USING (p)) AS bp, (SELECT sum(c.n * c.n / a.m) FROM c JOIN a USING (t)) AS br, (SELECT avg((k > 1)::INT) FROM a) AS fragmentation, (SELECT avg((k > 1)::INT) FROM b) AS merge)
      SELECT round(x / pp, 6) AS precision, round(x / tp, 6) AS recall, round(2 * (x / pp) * (x / tp) / (x / pp + x / tp), 6) AS f1, round(bp / n, 6) AS b3_precision, round(br / n, 6) AS b3_recall,
        round(2 * (bp / n) * (br / n) / (bp / n + br / n), 6) AS b3_f1, round((x - tp * pp / (n * (n - 1) / 2)) / ((tp + pp) / 2 - tp * pp / (n * (n - 1) / 2)), 6) AS ari, round(fragmentation, 6) AS fragmentation, round(merge, 6) AS merge FROM s""",
}
