"""The search service: filters, a ranking method, signals, walk, stories, excerpts and explanations in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import search_text as S
from weftline.functions import text as T
from weftline.operators.graphs import pagerank
from weftline.operators.lexical import blend, bm25_topk, signal_rerank, tfidf_topk
from weftline.operators.materialize import materialize
from weftline.operators.stories import hash_vectors
from weftline.operators.vectors import cosine_topk

METHODS = ["bm25", "tfidf", "hash", "match"]
OVERFETCH = 4


@dataclass
class Request:
    """What is asked for: each filter is left out where it is None. as_of_us is the moment that recency counts from."""

    query: str
    k: int = 10
    method: str = "bm25"
    topic: str | None = None
    language: str | None = None
    since_us: int | None = None
    until_us: int | None = None
    entity: str | None = None
    duplicates: bool = True
    rerank: bool = True
    walk: bool = False
    as_of_us: int = 0
    notes: list[str] = field(default_factory=list)


def filtered(articles: DataFrame, r: Request) -> DataFrame:
    """Filters as one conjunction on columns, so that those on columns of the table reach its scan."""
    keep = F.lit(True)
    if r.topic is not None:
        keep = keep & (F.col("topic") == r.topic)
    if r.language is not None:
        keep = keep & (F.lower("language") == r.language.lower())
    if r.since_us is not None:
        keep = keep & (F.unix_micros("retrieved_at") >= r.since_us)
    if r.until_us is not None:
        keep = keep & (F.unix_micros("retrieved_at") <= r.until_us)
    if not r.duplicates:
        keep = keep & ~F.coalesce("is_near_duplicate", F.lit(False))
    if r.entity is not None:
        keep = keep & F.lower(T.body_text(F.col("title"), F.col("excerpt"))).contains(r.entity.lower())
    return articles.filter(keep)


def ranked(docs: DataFrame, r: Request, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best of docs (id, title, excerpt) by the request's method. An unknown method is an error; a query without words has no hits."""
    spark = docs.sparkSession
    q = spark.createDataFrame([(0, r.query or "")], "query_id long, query string")
    if r.method == "bm25":
        return bm25_topk(docs, "id", F.col("title"), F.col("excerpt"), q, k)
    body = T.body_text(F.col("title"), F.col("excerpt"))
    if r.method == "tfidf":
        return tfidf_topk(docs, "id", body, q, k)
    if r.method == "match":
        hit = docs.filter(S.matches(body, *S.parse_query(r.query))).select(F.lit(0).cast("long").alias("query_id"), F.col("id").alias("doc_id"), F.lit(1.0).alias("score"))
        return hit.orderBy("doc_id").limit(k).withColumn("rank", F.lit(1))  # a top-k by id: all that match score alike
    if r.method == "hash":
        v = hash_vectors(docs.select("id", body.alias("_b")), "_b", out="embedding").select(F.col("id").alias("doc_id"), "embedding")
        asked = hash_vectors(q, "query", out="embedding").select("query_id", "embedding")
        return cosine_topk(v, asked, "doc_id", "embedding", k, exclude_self=False).filter("score > 0")
    raise ValueError(f"method {r.method!r} is none of {METHODS}")


def seeds(hits: DataFrame) -> DataFrame:
    """(node, weight): where a walk starts - the hits by their positive scores, all alike if none is positive."""
    top = hits.agg(F.max("score")).first()[0] or 0.0
    w = F.greatest(F.col("score"), F.lit(0.0)) if top > 0 else F.lit(1.0)
    return hits.select(F.concat(F.lit("article:"), F.col("doc_id").cast("string")).alias("node"), w.alias("weight"))


def of_kind(mass: DataFrame, kind: str = "article") -> DataFrame:
    """(doc_id, mass) of one kind of node."""
    return mass.filter(F.col("node").startswith(kind + ":")).select(F.expr(f"substr(node, {len(kind) + 2})").cast("long").alias("doc_id"), "mass")


def search(articles: DataFrame, r: Request, stories: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(rank, doc_id, score, title, story, excerpt, terms, explanation) of the request's hits.

    Filters come before ranking, so k hits come back where there are k; four times as many are ranked, then signals and, if asked for, a walk over
    edges (src, dst, weight) that starts from the hits order them anew. stories (doc_id, story) is looked up; a hit without one has null. A
    walk without edges is left out and said so in r.notes. Only the hits' texts are fetched."""
    docs = filtered(articles, r).dropDuplicates(["id"])
    hits = materialize(ranked(docs.select("id", "title", "excerpt"), r, r.k * OVERFETCH), "hits")
    first = hits.select("doc_id", F.col("score").alias("_base"))
    if r.rerank:
        about = docs.select(F.col("id").alias("doc_id"), F.unix_micros("retrieved_at").alias("published_us"), "is_near_duplicate")
        hits = signal_rerank(hits, about, r.as_of_us).select("query_id", "doc_id", "score", "rank")
    if r.walk and edges is None:
        r.notes.append("no graph: ranked without a walk")
    elif r.walk:
        hits = materialize(hits, "hits")
        mass, _ = pagerank(edges, seeds(hits), tolerance=1e-6)
        hits = blend(hits, of_kind(mass)).select("query_id", "doc_id", "score", "rank")
    top = materialize(hits.filter(F.col("rank") <= r.k).join(first, "doc_id"), "top")
    ids = [x[0] for x in top.select("doc_id").collect()]  # k rows
    shown = top.join(docs.filter(F.col("id").isin(ids)).select(F.col("id").alias("doc_id"), "title", "excerpt"), "doc_id")
    body = T.body_text(F.col("title"), F.col("excerpt"))
    told = shown.join(stories, "doc_id", "left") if stories is not None else shown.withColumn("story", F.lit(None).cast("string"))
    terms = S.term_overlap(F.lit(r.query), body)
    signals = F.create_map(F.lit(r.method), F.round("_base", 6), F.lit("final"), F.round("score", 6))
    return told.select("rank", "doc_id", F.round("score", 6).alias("score"), "title", "story", S.best_sentence(F.lit(r.query), body).alias("excerpt"), terms.alias("terms"), S.explain(signals, terms).alias("explanation"))
