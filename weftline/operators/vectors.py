"""Exact dense search in blocks, random projection, SVD, IVF and PQ."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.hashing import hash64

QUERY_BLOCK = 8_192  # queries whose vectors go to the executors at once
SCORES_AT_ONCE = 4_000_000


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix in double precision."""
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.empty((0, 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def cosine_topk(docs: DataFrame, queries: DataFrame, doc_id: str, vector: str, k: int, query_id: str = "query_id", exclude_self: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): exact top-k by cosine, ties by doc id.

    Queries (query_id, vector) go to the executors in blocks of at most block rows, whatever their number; each
    task keeps its own k best of every query of the block, so only k rows a query and task are shuffled
    and no pair leaves its task. Null vectors are neither docs nor queries."""
    spark = docs.sparkSession
    d = docs.filter(F.col(vector).isNotNull()).select(F.col(doc_id).cast("long").alias("_d"), F.col(vector).alias("_v"))
    q = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("_q"), F.col(vector).alias("_v"))
    blocks, last = [], None
    while True:
        part = (q if last is None else q.filter(F.col("_q") > last)).orderBy("_q").limit(block).collect()
        if not part:
            break
        last = part[-1]["_q"]
        blocks.append(spark.sparkContext.broadcast((np.array([r["_q"] for r in part]), unit_rows(np.array([r["_v"] for r in part], dtype=np.float64)))))
        if len(part) < block:
            break
    out = None
    for shared in blocks:

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            keep_s = np.full((len(ids), k), -np.inf)
            keep_d = np.full((len(ids), k), -1, dtype=np.int64)
            for batch in batches:
                size = max(1, SCORES_AT_ONCE // len(ids))
                for s in range(0, batch.num_rows, size):
                    part = batch.slice(s, size)
                    d_ids = np.asarray(part.column(0))
                    scores = np.round(m @ unit_rows(matrix(part.column(1))).T, 12)  # products depend on the block; equal vectors tie
                    if exclude_self:
                        scores = np.where(ids[:, None] == d_ids[None, :], -np.inf, scores)
                    scores = np.concatenate([keep_s, scores], axis=1)
                    names = np.concatenate([keep_d, np.broadcast_to(d_ids, (len(ids), len(d_ids)))], axis=1)
                    order = np.lexsort((names, -scores), axis=1)[:, :k]
                    keep_s, keep_d = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
            ok = np.isfinite(keep_s)
            who = np.broadcast_to(ids[:, None], keep_s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(who[ok]), pa.array(keep_d[ok]), pa.array(keep_s[ok])], names=["query_id", "doc_id", "score"])

        found = d.mapInArrow(best, "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def sparse_signs(dim_in: int, dim_out: int, seed: int = 549) -> list[list[float]]:
    """Sparse random projection (Li, Hastie, Church 2006) with s = sqrt(dim_in): entries of +-sqrt(s / dim_out), each with probability 1/(2s), from
    SHA-256 of seed and position, so that SQL can compute the same."""
    import hashlib

    s = dim_in**0.5
    out = []
    for i in range(dim_in):
        row = []
        for j in range(dim_out):
            u = int(hashlib.sha256(f"{seed}:{i}:{j}".encode()).hexdigest()[:8], 16) / 2**32
            row.append((s / dim_out) ** 0.5 * (1 if u < 1 / (2 * s) else -1 if u < 1 / s else 0))
        out.append(row)
    return out


def gaussian_matrix(dim_in: int, dim_out: int, seed: int = 549) -> np.ndarray:
    return np.random.default_rng(seed).normal(0.0, dim_out**-0.5, (dim_in, dim_out))


def project(vectors: DataFrame, vector: str, r: np.ndarray | list[list[float]]) -> DataFrame:
    """vectors with the vector column multiplied by a matrix (in the Arrow stage; the matrix has dim_in x dim_out entries)."""
    m = np.asarray(r, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def times(v):
        import pandas as pd

        return pd.Series(list(np.stack(v.to_numpy()).astype(np.float64) @ m) if len(v) else [])

    return vectors.withColumn(vector, times(F.col(vector)))


def svd_components(vectors: DataFrame, vector: str, k: int) -> np.ndarray:
    """Leading right singular vectors (dim x k) from one pass: every task adds up its Gram matrix, dim x dim numbers each."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for batch in batches:
            m = matrix(batch.column(0))
            if m.size:
                g = m.T @ m if g is None else g + m.T @ m
        if g is not None:
            n = g.shape[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(g))], names=["i", "row"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(vector).mapInArrow(gram, "i long, row array<double>")
    summed = rows.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    n = max((r["i"] for r in summed), default=-1) + 1
    g = np.zeros((n, n))
    for r in summed:
        g[r["i"], r["j"]] = r["x"]
    values, basis = np.linalg.eigh(g)
    v = basis[:, np.argsort(-values)[:k]]
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def kmeans(sample: np.ndarray, k: int, seed: int = 549, rounds: int = 25) -> np.ndarray:
    """Lloyd's algorithm with k-means++ seeding on a bounded sample; k is clamped to the rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    centres = sample[rng.integers(len(sample))][None, :]
    for _ in range(k - 1):
        d = ((sample[:, None, :] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, sample[rng.choice(len(sample), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(sample))]])
    for _ in range(rounds):
        own = ((sample**2).sum(1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)[None]).argmin(1)
        moved = np.array([sample[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


class IvfIndex:
    """Inverted lists over coarse cells, residuals flat or as product-quantiser codes.

    Fitting reads a bounded sample (the sample_rows rows of smallest hash of their id); every row is indexed. Searching probes the
    nearest cells of each query; probing all of them gives the exact ranking when residuals are flat."""

    def __init__(self, cells: int = 16, parts: int = 0, bits: int = 4, sample_rows: int = 20_000, seed: int = 549):
        self.cells, self.parts, self.bits, self.sample_rows, self.seed = cells, parts, bits, sample_rows, seed

    def fit(self, docs: DataFrame, doc_id: str, vector: str) -> IvfIndex:
        rows = docs.filter(F.col(vector).isNotNull()).select(doc_id, vector).orderBy(hash64(F.col(doc_id).cast("string")), doc_id).limit(self.sample_rows).collect()
        m = unit_rows(np.array([r[1] for r in rows], dtype=np.float64))
        self.centres = kmeans(m, self.cells, self.seed)
        if self.parts:
            own = (m @ self.centres.T - (self.centres**2).sum(1)[None] / 2).argmax(1)
            rest = np.split(m - self.centres[own], self.parts, axis=1)
            self.books = [kmeans(x, 1 << self.bits, self.seed + 1 + i) for i, x in enumerate(rest)]
        return self

    def index(self, docs: DataFrame, doc_id: str, vector: str) -> DataFrame:
        """(doc_id, cell, vec or code) of every row; write it with partitionBy("cell") to prune cells at read time."""
        centres, parts = self.centres, self.parts
        books = self.books if parts else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = unit_rows(matrix(batch.column(1)))
                own = (m @ centres.T - (centres**2).sum(1)[None] / 2).argmax(1)
                if books is None:
                    stored = list(m)
                else:
                    stored = list(np.stack([((x**2).sum(1)[:, None] - 2 * x @ b.T + (b**2).sum(1)[None]).argmin(1) for x, b in zip(np.split(m - centres[own], parts, axis=1), books)], axis=1).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(stored, pa.list_(pa.float64()))], names=["doc_id", "cell", "vec"])

        return docs.filter(F.col(vector).isNotNull()).select(F.col(doc_id).cast("long"), F.col(vector)).mapInArrow(run, "doc_id long, cell int, vec array<double>")

    def search(self, index: DataFrame, queries: DataFrame, query_id: str, vector: str, k: int, probes: int) -> DataFrame:
        """(query_id, doc_id, score, rank). Queries are joined with the cells they probe; a task scores one block of a cell's
        queries against that cell's rows and keeps k per query."""
        centres, parts = self.centres, self.parts
        books = self.books if parts else None

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = unit_rows(matrix(batch.column(1)))
                near = np.argsort(-(m @ centres.T - (centres**2).sum(1)[None] / 2), axis=1)[:, :probes]
                who = np.repeat(np.arange(len(m)), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(near.reshape(-1).astype(np.int32)), pa.array(list(m[who]), pa.list_(pa.float64()))], names=["query_id", "cell", "q"])

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            names, values, who = [], [], []
            if left.num_rows and right.num_rows:
                q, d = matrix(left.column("q").combine_chunks()), matrix(right.column("vec").combine_chunks())
                if books is not None:
                    c = centres[left.column("cell")[0].as_py()]
                    d = unit_rows(c[None] + np.concatenate([b[d[:, i].astype(int)] for i, b in enumerate(books)], axis=1))
                ids = np.asarray(right.column("doc_id"))
                for s in range(0, len(q), 256):
                    scores = np.round(q[s : s + 256] @ d.T, 12)
                    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                    who.append(np.repeat(np.asarray(left.column("query_id"))[s : s + 256], order.shape[1]))
                    names.append(ids[order].reshape(-1))
                    values.append(np.take_along_axis(scores, order, 1).reshape(-1))
            cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
            return pa.table({"query_id": cat(who, np.int64), "doc_id": cat(names, np.int64), "score": cat(values, np.float64)})

        probed = queries.filter(F.col(vector).isNotNull()).select(F.col(query_id).cast("long"), vector).mapInArrow(probe, "query_id long, cell int, q array<double>")
        met = probed.groupBy("cell").cogroup(index.groupBy("cell")).applyInArrow(score, "query_id long, doc_id long, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def hashed_pairs(vectors: DataFrame, row_id: str, per_row: int = 2) -> DataFrame:
    """(a, b): a fixed sample of pairs, per_row partners for every row: by hash of the id, the rows that follow it in the order of hashes
    within its bucket. Linear in the rows, the same for all projections."""
    h = hash64(F.concat(F.lit("pair:"), F.col(row_id).cast("string")))
    ring = vectors.select(F.col(row_id).alias("a"), h.alias("_h"), (F.shiftrightunsigned(h, 56)).alias("_bucket"))
    w = W.partitionBy("_bucket").orderBy("_h", "a")
    steps = [ring.select("a", F.lead("a", n).over(w).alias("b")) for n in range(1, per_row + 1)]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.filter("b IS NOT NULL")
