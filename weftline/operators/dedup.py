"""Exact and near duplicates: hash groups, complete blocking, ordered resolution."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.materialize import materialize

SMALL_GROUP, TILE, ROWS_OUT = 64, 1024, 100_000  # larger groups are compared in tiles; rows of a batch
MAX_BITS = 5  # SimHash distance up to which texts are near-duplicates
TITLE_THRESHOLD = 0.9
TOKEN_THRESHOLD = 0.8  # a title score of 0.9 needs a token similarity of 0.8


def exact_groups(rows: DataFrame, key: Column, row_id: str = "id") -> DataFrame:
    """(first_id, copies) of each key that several rows have. Null keys group nothing."""
    return rows.select(key.alias("_k"), row_id).filter(F.col("_k").isNotNull()).groupBy("_k").agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("first_id", "copies")


def _near_in_groups(max_bits: int, masks: list[int]):
    """An Arrow stage over rows (n, key, id, h) sorted by (n, key): (a, b, bits) of rows of one group up to max_bits apart, in either order.
    A pair is given only in the first of its common groups, so it comes once and nothing needs to be counted after it."""
    combos = list(combinations(range(len(masks)), 2))

    def once(x: np.ndarray, n: int) -> np.ndarray:
        i, j = combos[n]
        keep = np.ones(len(x), bool)
        for m in range(j):  # no other band before the group's second is equal
            if m != i:
                keep &= (x & np.uint64(masks[m] % (1 << 64))) != 0
        return keep

    def met(n: np.ndarray, key: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cut = np.flatnonzero((n[1:] != n[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(n))
        size = np.repeat(ends - starts, ends - starts)
        left = np.repeat(ends, ends - starts) - np.arange(len(n)) - 1  # rows of the group behind each
        left[size > SMALL_GROUP] = 0
        at, d = np.flatnonzero(left > 0), 1
        while len(at):  # small groups all together: each row meets the d-th behind it
            x = h[at] ^ h[at + d]
            bits = np.bitwise_count(x)
            hit = bits <= max_bits
            x, i, bits = x[hit], at[hit], bits[hit]
            for c in np.unique(n[i]):
                own = np.flatnonzero(n[i] == c)
                own = own[once(x[own], int(c))]
                yield i[own], i[own] + d, bits[own]
            d += 1
            at = at[left[at] >= d]
        for s, e in zip(starts, ends):
            if e - s > SMALL_GROUP:
                for r in range(s, e, TILE):
                    for q in range(r, e, TILE):
                        x = h[r : min(r + TILE, e), None] ^ h[None, q : min(q + TILE, e)]
                        u, v = np.nonzero(np.bitwise_count(x) <= max_bits)
                        if q == r:
                            u, v = u[u < v], v[u < v]
                        x = x[u, v]
                        own = np.flatnonzero(once(x, int(n[s])))
                        yield u[own] + r, v[own] + q, np.bitwise_count(x[own])

    def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows up to the last change of the group; what follows waits for the next batch."""
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            n, key = b.column("n").to_numpy(), b.column("key").to_numpy()
            first = next((w for w in waiting), b)
            if (first.column("n")[0].as_py(), first.column("key")[0].as_py()) == (n[-1], key[-1]):
                waiting.append(b)
                continue
            last = int(np.append(-1, np.flatnonzero((n != n[-1]) | (key != key[-1])))[-1]) + 1
            yield pa.Table.from_batches([*waiting, b.slice(0, last)])
            waiting = [b.slice(last)]
        if waiting:
            yield pa.Table.from_batches(waiting)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            t = t.combine_chunks()
            ids = t.column("id").combine_chunks()
            for i, j, bits in met(t.column("n").to_numpy(), t.column("key").to_numpy(), t.column("h").to_numpy().view(np.uint64)):
                for s in range(0, len(i), ROWS_OUT):
                    e = s + ROWS_OUT
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[s:e])), ids.take(pa.array(j[s:e])), pa.array(bits[s:e].astype(np.int32))], names=["x", "y", "bits"])

    return run


def simhash_pairs(hashes: DataFrame, row_id: str, simhash: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b, bits) of distinct SimHash values' representatives at most max_bits apart, a < b. Equal hashes are one value: collapse first.

    Of max_bits + 2 bands, max_bits changes leave two whole, so pairs of rows share a key of two bands: 21 keys of 18 bits for 5 changes. Rows are
    sorted by key once and a group's hashes are compared as numbers; no pair of rows is joined and none shuffled. Complete: no cap, no missed pair."""
    edges = [round(64 * n / (max_bits + 2)) for n in range(max_bits + 3)]
    masks = [((1 << b) - (1 << a)) - (1 << 64 if b == 64 else 0) for a, b in zip(edges, edges[1:])]  # as signed numbers
    both = F.lit([masks[i] | masks[j] for i, j in combinations(range(len(masks)), 2)])
    rows = hashes.select(F.col(row_id).alias("id"), F.col(simhash).alias("h")).filter("id IS NOT NULL AND h IS NOT NULL").distinct()
    k = rows.select("id", "h", F.posexplode(F.transform(both, lambda m: F.col("h").bitwiseAND(m))).alias("n", "key"))
    k = k.select("n", "key", "id", "h").repartition("n", "key").sortWithinPartitions("n", "key")
    kind = k.schema["id"].dataType.simpleString()
    near = k.mapInArrow(_near_in_groups(max_bits, masks), f"x {kind}, y {kind}, bits int").filter("x <> y")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "bits")


def token_pairs(rows: DataFrame, row_id: str, tokens: str, threshold: float = TOKEN_THRESHOLD) -> DataFrame:
    """(a, b) with token Jaccard similarity of threshold or more, a < b, by prefix filtering: tokens are
    ordered by their frequency, rarest first, and similar sets share one of their first n - ceil(t n) + 1 tokens; lengths and the token's
    places bound the partners further (what follows the first common token must suffice). A row carries its set to the token's list, so only pairs that
    reach the threshold leave it. Complete. Rows without tokens pair with nothing."""
    sets = rows.select(F.col(row_id).alias("id"), F.array_distinct(tokens).alias("t")).filter(F.size("t") > 0)
    long = sets.select("id", F.explode("t").alias("w"))
    df = long.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    ranked = long.join(df, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r")).select("id", F.transform("r", lambda x: x["w"]).alias("t"), F.size("r").alias("n"))
    first = F.slice("t", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int"))
    prefix = ranked.select("id", "n", "t", F.posexplode(first).alias("pos", "w"))
    left, right = (prefix.select("w", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "t", "pos")]) for x in "ab")
    least = F.ceil(threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    met = left.join(right, "w").filter((F.col("id_a") < F.col("id_b")) & (F.col("n_a") - F.col("pos_a") >= least) & (F.col("n_b") - F.col("pos_b") >= least))
    met = met.filter(F.size(F.array_intersect("t_a", "t_b")) >= least)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def title_pairs(rows: DataFrame, row_id: str, title: str, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """(a, b, score) of different titles' representatives (ids are bigint) that score threshold or more, with or without mastheads. Titles
    that are equal are one (their smallest id): groups of copies of any size cost as much as one row."""
    reps = rows.filter(F.col(title).isNotNull()).groupBy(title).agg(F.min(row_id).alias("id"))
    variants = reps.select("id", F.posexplode(F.array_distinct(F.array(F.col(title), T.strip_site_suffix(F.col(title))))).alias("n", "v"))
    v = materialize(variants.select("id", "v", (F.col("id") * 2 + F.col("n")).alias("vid"), T.token_set(F.col("v")).alias("t")).filter(F.size("t") > 0), "titles")
    met = token_pairs(v, "vid", "t")
    same = v.alias("l").join(v.alias("r"), "v").filter("l.id < r.id").select(F.col("l.vid").alias("a"), F.col("r.vid").alias("b"))
    # pairs are few by now: they fetch the texts, and shingles are made of these instead of being carried along
    side = lambda x: v.select(F.col("vid").alias(x), F.col("id").alias(f"id_{x}"), F.col("v").alias(f"v_{x}"))
    pairs = met.unionByName(same).join(side("a"), "a").join(side("b"), "b").filter("id_a <> id_b")
    score = T.title_score(*[T.token_set(F.col(c)) for c in ("v_a", "v_b")], *[T.char_shingles(F.col(c)) for c in ("v_a", "v_b")])
    scored = pairs.select(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"), score.alias("score"))
    return scored.select(F.col("x").alias("a"), F.col("y").alias("b"), "score").filter(F.col("score") >= threshold - 1e-9).groupBy("a", "b").agg(F.max("score").alias("score"))


def resolve_in_order(ids: DataFrame, pairs: DataFrame, order: str = "ord") -> DataFrame:
    """(id, original_id): who keeps and who is a duplicate of whom, when rows come in by (order, id) and only rows
    that are no duplicates themselves can be originals. original_id is the row's own id or the earliest original it pairs with.

    ids (id, ord), pairs (a, b) in any direction. In each round every row is settled whose earlier partners are all
    settled; rounds are as many as the longest chain of partners, each a few joins on the open rows only."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    o = ids.select("id", order)
    prior = both.join(o.select(F.col("id").alias("a"), F.col(order).alias("oa")), "a").join(o.select(F.col("id").alias("b"), F.col(order).alias("ob")), "b")
    prior = materialize(prior.filter(F.struct("ob", "b") < F.struct("oa", "a")).select(F.col("a").alias("id"), F.col("b").alias("prev"), F.col("ob").alias("prev_ord")), "prior")
    free = ids.select("id").join(prior.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("original_id"))
    settled = materialize(free, "settled")
    open_ = prior
    while True:
        state = open_.join(settled.select(F.col("id").alias("prev"), F.col("original_id").alias("po")), "prev", "left")
        kept = F.col("po") == F.col("prev")
        verdict = state.groupBy("id").agg(F.count_if(F.col("po").isNull()).alias("waiting"), F.min(F.when(kept, F.struct("prev_ord", "prev"))).alias("first"), F.min(F.when(F.col("po").isNull(), F.struct("prev_ord", "prev"))).alias("first_waiting"))
        done = verdict.filter((F.col("waiting") == 0) | (F.col("first").isNotNull() & (F.col("first") < F.col("first_waiting"))))
        new = materialize(done.select("id", F.coalesce(F.col("first.prev"), F.col("id")).alias("original_id")), "settled")
        if new.isEmpty():
            return settled
        settled = settled.unionByName(new)
        open_ = materialize(open_.join(new.select("id"), "id", "left_anti"), "open")
