"""Lexical retrieval over postings: TF-IDF, BM25, re-ranking by signals."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.text import QUERY_STOP, bound, tokens
from weftline.operators.materialize import materialize

K1, B, TITLE_WEIGHT = 1.2, 0.75, 2.0
BLOCK_POSTINGS = 6_000_000  # of documents whose inverted lists a task holds at once


def grams(text: Column, stop: list[str] = QUERY_STOP) -> Column:
    """Tokens without stop words, and neighbours of them joined by a space."""

    def both(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat(F.get(t, i - 1), F.lit(" "), F.coalesce(F.get(t, i), F.lit(""))))
        return F.when(F.size(t) < 2, t).otherwise(F.concat(t, pairs))

    return bound(F.filter(tokens(text), lambda x: ~x.isin(stop) & (F.length(x) > 1)), both)


def postings(docs: DataFrame, doc_id: str, *parts: tuple[Column, float]) -> DataFrame:
    """(doc_id, t, f, dl), one row a document: its distinct terms as 64-bit hashes (two terms of a vocabulary of a million share one with a
    probability of 3e-8), their weighted counts and the sum of these. parts are (array of terms, weight of each). doc_id identifies a row of docs, so nothing is shuffled."""
    weights = [w for _, w in parts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(i + 1) for i in range(len(weights))]
            rows = np.concatenate([np.repeat(np.arange(batch.num_rows), np.diff(x.offsets.to_numpy())) for x in lists])
            t = np.concatenate([x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists])
            f = np.concatenate([np.full(len(x.flatten()), w) for x, w in zip(lists, weights)])
            order = np.lexsort((t, rows))
            rows, t, f = rows[order], t[order], f[order]
            first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (t[1:] != t[:-1]))[: len(t)])
            f = np.add.reduceat(f, first) if len(first) else f
            rows, t = rows[first], t[first]
            at = np.append(0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))).astype(np.int32)
            dl = np.bincount(rows, f, minlength=batch.num_rows).astype(np.float64)  # integers where there is no row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(t)), pa.ListArray.from_arrays(at, pa.array(f)), pa.array(dl)], names=["doc_id", "t", "f", "dl"])

    hashed = [F.transform(terms, lambda x: F.xxhash64(x)).alias(f"_t{i}") for i, (terms, _) in enumerate(parts)]
    return docs.select(F.col(doc_id).alias("doc_id"), *hashed).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, t array<bigint>, f array<double>, dl double")


def _open(uri: str) -> pq.ParquetFile:
    where, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(where.open_input_file(path))


def _best_in_blocks(weigh: Callable[..., np.ndarray], queries: list[str], k: int):
    """An Arrow stage over postings: (query_id, doc_id, score) of the k best of every block of documents for each query of the files. Scores are sums over
    the inverted lists of a block; no pair of query and document leaves it but those. weigh(t, f, dl, d) gives each posting's weight."""

    def best(docs: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(docs).combine_chunks()
        ids, t = table.column("doc_id").combine_chunks(), table.column("t").combine_chunks()
        d = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(t.offsets.to_numpy()))
        t = t.flatten().to_numpy()
        w = weigh(t, table.column("f").combine_chunks().flatten().to_numpy(), table.column("dl").to_numpy(), d)
        order = np.argsort(t, kind="stable")
        t, d, w = t[order], d[order], w[order]
        del order
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
        ends, terms = np.append(starts[1:], len(t)), t[starts]
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(ids))
        columns = -(-len(ids) // 64)  # the k-th best of the columns' bests is no better than the k-th best document
        total = np.zeros(64 * columns)
        grid = total.reshape(64, columns)
        for uri in queries:
            for batch in _open(uri).iter_batches(batch_size=4096):
                at, qt, qw = batch.column("t").offsets.to_numpy(), batch.column("t").flatten().to_numpy(), batch.column("w").flatten().to_numpy()
                at = at - at[0]
                found = np.minimum(np.searchsorted(terms, qt), max(len(terms) - 1, 0))
                met = terms[found] == qt if len(terms) else np.zeros(len(qt), bool)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for q in range(batch.num_rows):
                    hit = [i for i in range(at[q], at[q + 1]) if met[i]]
                    if not hit:
                        continue
                    for i in hit:
                        s, e = starts[found[i]], ends[found[i]]
                        total[d[s:e]] += qw[i] * w[s:e]
                    top = grid.max(axis=0)
                    least = np.partition(top, columns - k)[columns - k] - 2e-8 if columns > k else 0.0
                    c = np.flatnonzero((top >= least) & (top > 0))
                    part = grid[:, c]
                    i, j = np.nonzero((part >= least) & (part > 0))
                    doc, score = i * columns + c[j], part[i, j]
                    if len(doc) > k:
                        o = np.lexsort((place[doc], -np.round(score, 8)))[:k]
                        doc, score = doc[o], score[o]
                    out.append((np.full(len(doc), q), doc, score))
                    total.fill(0)
                if out:
                    q, doc, score = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(q)), ids.take(pa.array(doc)), pa.array(score)], names=["query_id", "doc_id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = [], 0
        for b in batches:
            docs.append(b)
            size += len(b.column("t").flatten())
            if size > BLOCK_POSTINGS:
                yield from best(docs)
                docs, size = [], 0
        if docs:
            yield from best(docs)

    return run


def _hits(posts: DataFrame, size: int, queries: DataFrame, weigh: Callable[..., np.ndarray], k: int) -> DataFrame:
    """queries (query_id, term, w) against posts: the k best of each block are gathered and ranked."""
    q = materialize(queries.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("x")).select("query_id", F.col("x.term").alias("t"), F.col("x.w").alias("w")), "queries")
    rows = posts.filter("doc_id IS NOT NULL").coalesce(max(posts.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_POSTINGS)))
    kind = [x.schema[c].dataType.simpleString() for x, c in ((q, "query_id"), (posts, "doc_id"))]
    return top_by_score(rows.mapInArrow(_best_in_blocks(weigh, q.inputFiles(), k), f"query_id {kind[0]}, doc_id {kind[1]}, score double"), k)


def _frequencies(posts: DataFrame) -> DataFrame:
    """(term, df), each file in the order of term."""
    return materialize(posts.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term"), "df")


def _counts(posts: DataFrame) -> tuple[int, int, float]:
    """Documents, postings and the sum of lengths."""
    n, size, dl = posts.agg(F.count(F.lit(1)), F.sum(F.size("t")), F.sum("dl")).first()
    return n, size or 0, dl or 0.0


def top_by_score(scored: DataFrame, k: int) -> DataFrame:
    """k best per query, ties (in eight decimals: sums depend on their order) by doc id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def tfidf_topk(docs: DataFrame, doc_id: str, text: Column, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) for queries (query_id, query), documents' statistics only. Only documents that share a term meet a query.

    Postings are written once, a row a document. Each block of them reads the terms' frequencies file by file for its lengths, and the queries batch by batch."""
    posts = materialize(postings(docs, doc_id, (grams(text), 1.0)), "postings")
    n, size, _ = _counts(posts)
    df = _frequencies(posts)
    files = df.inputFiles()

    def weigh(t: np.ndarray, f: np.ndarray, dl: np.ndarray, d: np.ndarray) -> np.ndarray:
        terms, which = np.unique(t, return_inverse=True)
        each = np.zeros(len(terms))
        for uri in files:
            for b in _open(uri).iter_batches(batch_size=1 << 20):
                key, count = b.column("term").to_numpy(), b.column("df").to_numpy()
                lo, hi = np.searchsorted(terms, key[0]), np.searchsorted(terms, key[-1], "right")
                at = np.searchsorted(key, terms[lo:hi])
                same = key[at] == terms[lo:hi]
                each[lo:hi][same] = count[at[same]]
        w = (1 + np.log(f)) * (np.log((1 + n) / (1 + each)) + 1)[which]
        return w / np.sqrt(np.bincount(d, w * w, minlength=len(dl)))[d]

    weight = (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)
    q = postings(queries, "query_id", (grams(F.col("query")), 1.0)).select(F.col("doc_id").alias("query_id"), F.explode(F.arrays_zip("t", "f")).alias("x"))
    q = q.select("query_id", F.col("x.t").alias("term"), F.col("x.f").alias("tf")).join(df, "term").select("query_id", "term", weight.alias("w"))
    unit = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("query_id")))
    return _hits(posts, size, q.select("query_id", "term", unit.alias("w")), weigh, k)


def bm25_topk(docs: DataFrame, doc_id: str, title: Column, body: Column, queries: DataFrame, k: int) -> DataFrame:
    """Okapi BM25 with title terms counted twice, any query term may match."""
    posts = materialize(postings(docs, doc_id, (tokens(title), TITLE_WEIGHT), (tokens(body), 1.0)), "postings")
    n, size, total = _counts(posts)
    avg = total / max(n, 1) or 1.0

    def weigh(t: np.ndarray, f: np.ndarray, dl: np.ndarray, d: np.ndarray) -> np.ndarray:
        return f * (K1 + 1) / (f + K1 * (1 - B + B * dl[d] / avg))

    q = queries.select("query_id", F.explode(F.transform(F.array_distinct(tokens(F.col("query"))), lambda x: F.xxhash64(x))).alias("term"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _hits(posts, size, q.join(_frequencies(posts), "term").select("query_id", "term", idf.alias("w")), weigh, k)


def signal_rerank(hits: DataFrame, docs: DataFrame, as_of_us: int, half_life_hours: float = 48.0, recency_share: float = 0.25, duplicate_penalty: float = 0.5) -> DataFrame:
    """hits (query_id, doc_id, score) joined with docs (doc_id, published_us, is_near_duplicate): score blended with recency, halved for duplicates,
    ranked anew. A document without time counts as fresh."""
    age = F.greatest(F.lit(0.0), (F.lit(as_of_us) - F.col("published_us")) / 3.6e9)
    recency = F.coalesce(F.pow(F.lit(0.5), age / half_life_hours), F.lit(1.0))
    penalty = F.when(F.col("is_near_duplicate"), duplicate_penalty).otherwise(1.0)
    both = hits.join(docs, "doc_id").withColumn("score", ((1 - recency_share) * F.col("score") + recency_share * recency) * penalty)
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), "doc_id")))


def blend(hits: DataFrame, mass: DataFrame, alpha: float = 0.7) -> DataFrame:
    """hits blended with a mass (doc_id, mass), min-max scaled over each query's candidates; a missing mass is 0."""
    w = W.partitionBy("query_id")
    m = F.coalesce("mass", F.lit(0.0))
    lo, hi = F.min(m).over(w), F.max(m).over(w)
    span = F.when(hi > lo, hi - lo).otherwise(1.0)
    both = hits.join(mass, "doc_id", "left").withColumn("_s", (m - lo) / span)
    both = both.withColumn("score", alpha * F.col("score") + (1 - alpha) * F.col("_s"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), "doc_id"))).drop("_s", "mass")
