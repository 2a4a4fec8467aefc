"""Near-duplicate records: bottom-k sketches, inverted lists, union-sketch filter, exact Jaccard.

One hash function maps words to 64 bits. A record retains its k smallest values in an order that all records
share: by how often the collection has the value (in powers of two, from a table of fixed size), then by the hash. So what is
retained is rare first, and k follows the record's size: of two sets that are similar enough, the one with fewer words
keeps enough values to share one with the other (its least k1 values with the other's least k2), whatever the order. The
inverted lists of the retained values therefore meet every pair. Rows of a list carry the set's
size, the value's place in the order and 128 bits of the set; together they bound the overlap of a pair
exactly, and what can't reach the threshold ends in the list: rows are ordered by size, so a row meets just one stretch of its list, and
stretches are compared in blocks of numbers. Lists of very frequent values are split in blocks. Every pair of a stretch is still looked at, so time
grows with the square of the records that share their rarest words. Of the pairs that are left
the sketches of the plain hash (SKETCH smallest values) estimate the similarity from the union's smallest
values; what stands far below the threshold is dropped, and the exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.cleaning import words
from weftline.operators.materialize import drop_path, materialize

SKETCH = 24
SLACK = 0.4  # how far an estimate may stand below the threshold: 4.2 standard errors of 24 values at 0.7
SEED = 549
MIN_BITS, MAX_BITS = 16, 26  # of the table of frequencies: 64 kB to 64 MB
BLOCK_CLASS = 19  # lists of values that more than 2^19 records have are split
STEP = 1 << 18  # rows of lists that are paired at once
PAIRS = 1 << 20  # pairs that are compared at once
FOLDED = 22  # words apart up to which 64 bits tell enough at first
LONG = 128  # rows to meet from which a row is compared as part of a block


def sketch_records(records: DataFrame, row_id: str, texts: list[str]) -> DataFrame:
    """(row_id, w, h): the record's distinct words as sorted 32-bit codes of the one hash (w) and 128 bits that stand for the whole
    set (h). Records without any word are left out: nothing is similar to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                ids, sets, names = [], [], []
                cols = [part.column(k + 1).to_pylist() for k in range(len(texts))]
                for i, row in zip(part.column(0).to_pylist(), zip(*cols)):
                    distinct = set(words(" ".join(x for x in row if x)))
                    if not distinct:
                        continue
                    codes = []
                    for x in distinct:
                        c = known.get(x)
                        if c is None:
                            if len(known) > 1_000_000:
                                known.clear()
                            c = known[x] = xxhash.xxh3_64_intdigest(x, SEED) - (1 << 63)
                        codes.append(c)
                    a = np.sort(np.array(codes, dtype=np.int64))
                    ids.append(i)
                    sets.append(a)
                    names.append(xxhash.xxh3_128_digest(a.tobytes()))
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(names, pa.binary())], names=["id", "w", "h"])

    return records.select(F.col(row_id).cast("long").alias("id"), *[F.col(t).cast("string").alias(f"_t{k}") for k, t in enumerate(texts)]).mapInArrow(run, "id long, w array<long>, h binary")


def frequencies(sets: DataFrame, bits: int | None = None) -> np.ndarray:
    """A table of 2^bits numbers, by the upper bits of the hash: the number of records that have a value there, as the exponent of the next power of two.
    Counted over all records; bits follow the number of words between fixed bounds, so what is broadcast has a fixed bound as well.
    Values that share a place are ranked as one frequency, which costs time but no pair."""
    if bits is None:
        total = sets.agg(F.sum(F.size("w"))).first()[0] or 1
        bits = max(MIN_BITS, min(MAX_BITS, int(total).bit_length() - 1))
    place = F.shiftrightunsigned("x", 64 - bits)
    per = sets.select(F.explode("w").alias("x")).groupBy(place.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = per.groupBy((F.col("k") / 1024).cast("long").alias("g")).agg(F.collect_list(F.struct((F.col("k") % 1024).cast("int").alias("k"), F.ceil(F.log2("n")).cast("byte").alias("c"))).alias("r"))
    table = np.zeros(1 << bits, np.uint8)
    for batch in rows.toArrow().to_batches():  # at most 2^bits / 1024 rows
        lists = batch.column(1)
        at = np.repeat(batch.column(0).to_numpy() * 1024, np.diff(np.asarray(lists.offsets)))
        flat = lists.flatten()
        table[at + flat.field(0).to_numpy()] = flat.field(1).to_numpy()
    return table


def retained(threshold: float, table: Broadcast):
    """Arrow stage from sets (id, w) to the rows of their inverted lists: key (value and block), id, size, twice the place in the common order (plus one
    where the set can be found) and 128 bits of the set.

    A set looks for sets of its size and below by its n - ceil(t n) + 1 least values, in every block; it is found under the first
    n - ceil(2 t n / (1 + t)) + 1 of them, in one block each, so one row serves for both. Values that no other set has are in no list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = table.value
        shift = np.uint64(64 - int(len(classes)).bit_length() + 1)
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                ids, col = part.column(0).to_numpy(), part.column(1)
                w = np.asarray(col.flatten()).view(np.uint64)
                n = np.asarray(pa.compute.list_value_length(col)).astype(np.int64)
                start = np.append(0, np.cumsum(n))[:-1]
                owner = np.repeat(np.arange(len(n)), n)
                c = classes[w >> shift].astype(np.uint64)
                order = np.lexsort(((c << np.uint64(58)) | (w >> np.uint64(6)), owner))
                pos = np.arange(len(w)) - start[owner]
                asks, found = (n - np.ceil(x * n - 1e-9).astype(np.int64) + 1 for x in (threshold, 2 * threshold / (1 + threshold)))
                cls = c[order].astype(np.int64)
                take = (pos < asks[owner]) & (cls > 0)
                low, high = (np.bitwise_or.reduceat(np.where((w >> np.uint64(7)) & np.uint64(1) == k, np.uint64(1) << (w & np.uint64(63)), np.uint64(0)), start) for k in (np.uint64(0), np.uint64(1)))
                who, at, value = owner[take], pos[take], w[order][take]
                blocks = np.int64(1) << np.maximum(0, cls[take] - BLOCK_CLASS)
                own = (ids[who].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % blocks
                copies = np.repeat(np.arange(len(who)), blocks)
                block = np.arange(len(copies)) - np.repeat(np.append(0, np.cumsum(blocks))[:-1], blocks)
                who, at, value, own = who[copies], at[copies], value[copies], own[copies]
                key = (value ^ (block.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))).view(np.int64)
                place = 2 * at + ((at < found[who]) & (block == own))
                cols = [key, ids[who], n[who].astype(np.int32), place.astype(np.int32), low[who].view(np.int64), high[who].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "id", "n", "place", "low", "high"])

    return run


def list_pairs(threshold: float, key: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a < b, of the pairs of each list that size, place and bits don't exclude. Rows are whole lists, ordered by key, size and id."""
    share = threshold / (1 + threshold)  # of the words of both, what both must have
    n, at, found = n.astype(np.int64), place.astype(np.int64) >> 1, np.flatnonzero(place & 1)
    low, high = low.view(np.uint64), high.view(np.uint64)
    number = np.append(0, np.cumsum(key[1:] != key[:-1])) << 32
    least, most = np.ceil(threshold * n - 1e-9).astype(np.int64), np.minimum(n, np.floor((n - at + 1e-9) / share - n).astype(np.int64))  # sizes that a row can meet
    sizes = (number + n)[found]
    lo = np.searchsorted(sizes, number + least)
    hi = np.minimum(np.searchsorted(found, np.arange(len(n))), np.searchsorted(sizes, number + np.maximum(most, 0), "right"))
    limit = np.floor((1 - 2 * share) * (n + most) + 1e-6)  # words of one side only, at most
    fold = low ^ high  # differs in no more bits than the 128
    sides = fold[found], low[found], high[found]

    def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = found[j]
        both = n[i] + n[f]
        need = share * both - 1e-9
        apart = np.bitwise_count(low[i] ^ low[f]).astype(np.int64) + np.bitwise_count(high[i] ^ high[f])
        ok = (n[f] - at[f] >= need) & (n[i] - at[i] >= need) & (apart <= both - 2 * need)
        a, b = ids[i[ok]], ids[f[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    count = hi - lo
    few = np.flatnonzero((count > 0) & (count < LONG))
    ends = np.cumsum(count[few])
    s = 0
    while s < len(few):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, "right")))
        c = count[few[s:e]]
        i = np.repeat(few[s:e], c)
        j = np.arange(len(i)) + np.repeat(lo[few[s:e]] - np.append(0, np.cumsum(c))[:-1], c)
        near = np.bitwise_count(fold[i] ^ sides[0][j]) <= limit[i]
        yield exact(i[near], j[near])
        s = e
    many = np.flatnonzero(count >= LONG)
    many = many[np.lexsort((hi[many], lo[many]))]  # neighbours meet nearly the same rows
    cuts = np.append(0, np.flatnonzero(np.diff(number[many])) + 1)
    for s, e in zip(cuts, np.append(cuts[1:], len(many))):
        for x in range(s, e, 64):
            i = many[x : min(e, x + 64)]
            bound, last = np.minimum(limit[i], 255).astype(np.uint8)[:, None], int(hi[i].max())
            for y in range(int(lo[i].min()), last, 2048):
                z = min(last, y + 2048)
                if bound.max() <= FOLDED:
                    apart = np.bitwise_count(fold[i][:, None] ^ sides[0][y:z])
                else:
                    apart = np.bitwise_count(low[i][:, None] ^ sides[1][y:z]) + np.bitwise_count(high[i][:, None] ^ sides[2][y:z])
                r, j = np.divmod(np.flatnonzero(apart <= bound), z - y)  # faster than in two dimensions
                if len(r):
                    i2, j = i[r], j + y
                    ok = (j >= lo[i2]) & (j < hi[i2])
                    yield exact(i2[ok], j[ok])


def meetings(threshold: float):
    """Arrow stage from the rows of inverted lists, ordered by key, size and id, to pairs (a, b). It holds STEP rows or one list, whatever is more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in list_pairs(threshold, *cols):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, rows, limit = [], 0, STEP
        for batch in batches:
            held.append([x.to_numpy() for x in batch.columns])
            rows += batch.num_rows
            if rows < limit:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on
            if cut:
                yield from pairs([x[:cut] for x in cols])
            held, rows = [[x[cut:].copy() for x in cols]], rows - cut
            limit = max(STEP, 2 * rows)
        if rows:
            yield from pairs([np.concatenate(x) for x in zip(*held)])

    return run


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of distinct sets (id, w), a < b, with Jaccard similarity of threshold or more."""
    table = sets.sparkSession.sparkContext.broadcast(frequencies(sets))
    rows = sets.select("id", "w").mapInArrow(retained(threshold, table), "key long, id long, n int, place int, low long, high long")
    met = rows.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(meetings(threshold), "a long, b long").distinct()
    wa = sets.select(F.col("id").alias("a"), F.col("w").alias("wa"))
    wb = sets.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    union = F.slice(F.array_sort(F.array_union(F.slice("wa", 1, SKETCH), F.slice("wb", 1, SKETCH))), 1, SKETCH)  # the smallest values of the union
    shared = F.size(F.array_intersect(union, F.array_intersect(F.slice("wa", 1, SKETCH), F.slice("wb", 1, SKETCH))))
    both = met.join(wa, "a").join(wb, "b").filter(shared >= (threshold - SLACK) * F.size(union))
    common = F.size(F.array_intersect("wa", "wb"))
    exact = both.select("a", "b", common.alias("c"), (F.size("wa") + F.size("wb") - common).alias("u"))
    return exact.filter(F.col("c") >= threshold * F.col("u") - 1e-9).select("a", "b", (F.col("c") / F.col("u")).alias("similarity"))


def near_pairs(records: DataFrame, row_id: str, texts: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs). membership: (id, class) - class is the smallest id with the same words; pairs: (a, b, similarity) of
    classes, a < b. Copies are so collapsed before any pairing, and a group of copies of any
    size costs as much as one record. Nulls count as empty; records without words are in neither;
    a repeated id counts once."""
    members = materialize(sketch_records(records.dropDuplicates([row_id]), row_id, texts), "sets")
    classes = members.groupBy("h").agg(F.min("id").alias("class"))
    membership = materialize(members.select("id", "h").join(classes, "h").select("id", "class"), "classes")
    reps = membership.filter("id = class").select("id")
    distinct = materialize(members.join(reps, "id", "left_semi").select("id", "w"), "distinct")
    for path in {p.rsplit("/", 1)[0] for p in members.inputFiles()}:  # nothing reads them again
        drop_path(records.sparkSession, path)
    return membership, similar_sets(distinct, threshold)
