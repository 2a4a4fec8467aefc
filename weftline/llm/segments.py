"""Deduplicating new batches against all history: immutable suffix arrays, merged logarithmically.

A segment is one sorted table of the texts of some batches, cut into files of bounded size, written
once. Its rows are entries of a suffix array (one per word position of a text: the rest of the text
from there, and the id of the record), and one record row per text. Which file holds which range of keys
is kept in a small list, and a file's row groups carry their least and greatest key, so a new batch reads
the row groups its searches fall in, in the order in which they are stored, and nothing else.

A new text is cut into slips + 2 stretches. Whatever slips slips do to it (one of them may cut a word in
two, which touches two words), one stretch is left whole, so binary searches for the stretches meet every
earlier text that it can repeat. The words that the meetings cover are added up per record. A record that
is covered wholly is the same text; of the others, whose word signatures and numbers of letters must be near, the texts are
fetched by record id and compared word by word. Texts of fewer words than stretches are searched by
their words with letters left out, so that slips in every word are met as well.

Batches enter as level 0; a run of equal levels is merged in the same write, so n batches are at most
log2(n) + 1 segments and a text is rewritten log2(n) times. The list of segments is a file in the
history's folder, from which a later session goes on (TextHistory.open)."""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.headlines import same_headline, slipped_filler
from weftline.operators.materialize import drop_path, new_path

SLIPS = 3
ENTRIES_PER_FILE = 250_000
ENTRIES_PER_TASK = 20_000  # from which a new batch is written in parallel
SEARCHES_PER_TASK = 100_000
GROUP_BYTES = 96 * 1024  # of a row group before compression: what one search reads at least
FOOTERS_AT_ONCE = 32
SHIFT = 2  # words by which a stretch may stand elsewhere: same_headline takes texts that differ by two words at most
LONG_WORD = 32  # letters from which a word of a short text is searched by pieces instead of with letters left out
PIECE = 64
END = "\U0010ffff"
ENTRY = "key string, rec long, ts long, pos int, n int, bits long, letters long, text string"
ASKED = "key string, a int, size int, n int, bits long, letters long, q long, last long, file int"
SAMPLE = 2000  # texts whose entries tell where a batch's array is cut into files


def record_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def record_key(rec: int) -> str:
    return f"r|{rec + (1 << 63):016x}"


def numbers_of(words: list[str]) -> str:
    """The numbers of a text in order: texts with other numbers never repeat each other, so entries are sorted within them."""
    return ",".join(w for w in words if w[0].isdigit())


def signature(words: list[str]) -> int:
    """64 bits of which each word sets one, as a signed number."""
    bits = 0
    for w in words:
        bits |= 1 << (xxhash.xxh32_intdigest(w) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def letter_counts(texts: list[str]) -> list[int]:
    """How often letters of each of 16 kinds stand in a text, four bits each (so up to a multiple of 16), as a signed number; 0 for texts with a
    slipped filler, which a repeat may lack."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    kind = (codes * np.uint32(0x9E3779B1)) >> np.uint32(28)
    owner, own = np.cumsum(codes == 10), codes > 32
    counts = np.bincount(owner[own] * 16 + kind[own], minlength=16 * len(texts)).reshape(len(texts), 16).astype(np.uint64) & np.uint64(15)
    packed = np.bitwise_or.reduce(counts << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64).tolist()
    return [0 if any(map(slipped_filler, t.split(" "))) else p for t, p in zip(texts, packed)]


def letters_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so many letters stand in one of two texts only."""
    out = np.zeros(len(a), np.int64)
    for s in range(0, 64, 4):
        d = np.abs((a >> s & 15) - (b >> s & 15))
        out += np.minimum(d, 16 - d)
    return out


def shortened(word: str) -> set[str]:
    """The word and what is left of it without one letter, from six letters on also without two: words one slip (two slips) apart share one of them."""
    out = {word}
    for k in (1, 2) if len(word) >= 6 else (1,):
        if len(word) > k:
            out.update("".join(c) for c in combinations(word, len(word) - k))
    return out


def short_keys(words: list[str], sig: str, search: bool) -> set[str]:
    """Keys of a short text: each word and all words run together with letters left out; long words by pieces, of which slips leave one whole."""
    out = set()
    for w in {*words, "".join(words)}:
        if len(w) <= LONG_WORD:
            out |= {f"v|{sig}|{x}|" for x in shortened(w)}
        if len(w) > LONG_WORD - 2 and not search:
            out |= {f"l|{sig}|{w[i : i + PIECE]}" for i in range(len(w))}
        elif len(w) > LONG_WORD and search:
            size = min(len(w) // 3, PIECE)
            out |= {f"l|{sig}|{w[i * size : (i + 1) * size]}" for i in range(3)}
    return out


def entries_of(text: str, slips: int) -> list[tuple[str, int]]:
    """(key, word position) of a text's entries: the numbers and the rest from each word on, and for a short text its short keys."""
    w = text.split(" ")
    sig = numbers_of(w)
    out = [(f"t|{sig}|{' '.join(w[i:])} ", i) for i in range(len(w) if len(w) <= 2 * (slips + 2) + SHIFT else len(w) - 1)]
    if len(w) < slips + 2 + SHIFT:
        out += [(k, 0) for k in sorted(short_keys(w, sig, False))]
    return out


def searches_of(text: str, slips: int) -> list[tuple[str, int, int]]:
    """(key, first word, words): slips + 2 stretches of near equal length, or the short keys and the whole of a text with fewer words."""
    w = text.split(" ")
    sig = numbers_of(w)
    n = slips + 2
    if len(w) < n:
        return [(f"t|{sig}|{' '.join(w)} ", 0, len(w)), *((k, 0, 0) for k in sorted(short_keys(w, sig, True)))]
    cuts = [round(i * len(w) / n) for i in range(n + 1)]
    return [(f"t|{sig}|{' '.join(w[a:b])} ", a, b - a) for a, b in zip(cuts, cuts[1:])]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class SortedFile:
    """One file of a segment, read by row groups."""

    def __init__(self, path: str):
        where, name = _open(path)
        self.file = pq.ParquetFile(where.open_input_file(name))
        meta = self.file.metadata
        stats = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        self.sizes = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
        self.lo = [s.min if s is not None and s.has_min_max else None for s in stats]
        self.hi = [s.max if s is not None and s.has_min_max else None for s in stats]
        for i in range(len(self.lo)):  # a key too long for the footer: nothing is known of its row group but its neighbours
            if self.lo[i] is None:
                self.lo[i] = self.hi[i - 1] if i and self.hi[i - 1] is not None else ""
                self.hi[i] = None
        self.hi = [h if h is not None else END * 8 for h in self.hi]
        self.top = list(np.maximum.accumulate(np.array(self.hi, dtype=object))) if self.hi else []

    def groups(self, lo: str, hi: str) -> range:
        """Row groups that may hold keys of [lo, hi)."""
        return range(bisect_left(self.top, lo), bisect_left(self.lo, hi))


def whole(key: str) -> bool:
    """Whether a search is for the key itself (exact items, records), not for all keys that it opens."""
    return key[0] in "kr"


def above(key: str) -> str:
    """What is greater than every key that a search for this one can meet."""
    return key + ("\0" if whole(key) else END)


def look_up(path: str, asked: pa.RecordBatch, columns: list[str], cache: dict[str, SortedFile]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of the row groups that may hold asked keys, and for each of these its first row and the one after its last. Keys are compared
    as bytes where a binary search touches them; the others are never made Python strings."""
    f = cache.get(path)
    if f is None:
        f = cache[path] = SortedFile(path)
    keys = asked.column("key").to_pylist()
    spans = [f.groups(k, above(k)) for k in keys]
    groups = sorted({g for r in spans for g in r})
    rows = f.file.read_row_groups(groups, columns=["key", *columns])
    begin = dict(zip(groups, np.cumsum([0, *(f.sizes[g] for g in groups)]).tolist()))
    col = rows.column("key").combine_chunks()
    col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    at = memoryview(np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1]) if len(col) else memoryview(np.zeros(1, kind))
    data = col.buffers()[2].to_pybytes() if len(col) else b""
    left, right = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for i, (key, span) in enumerate(zip(keys, spans)):
        if not span:
            continue
        k, n, alone = key.encode(), len(key.encode()), whole(key)
        lo, end = begin[span[0]], begin[span[-1]] + f.sizes[span[-1]]
        hi = end
        while lo < hi:
            mid = (lo + hi) >> 1
            if data[at[mid] : at[mid + 1]] < k:
                lo = mid + 1
            else:
                hi = mid
        left[i] = lo
        step, hi = 1, lo  # rows met lie next to each other: hi steps beyond them, then the last step is halved
        while hi < end and data[at[hi] : at[hi + 1] if alone else min(at[hi] + n, at[hi + 1])] == k:
            lo, hi, step = hi + 1, hi + step, 2 * step
        hi = min(hi, end)
        while lo < hi:
            mid = (lo + hi) >> 1
            if data[at[mid] : at[mid + 1] if alone else min(at[mid] + n, at[mid + 1])] == k:
                lo = mid + 1
            else:
                hi = mid
        right[i] = lo
    return rows, left, right


@dataclass
class Segment:
    level: int
    path: str
    rows: int
    files: list[tuple[str, str, str]]  # path, least key, greatest key


def _footer(path: str) -> tuple[str, str, str, int]:
    f = SortedFile(path)
    return path, f.lo[0] if f.lo else "", f.top[-1] if f.top else "", sum(f.sizes)


class TextHistory:
    """All texts and exact keys taken in so far, as segments of sorted arrays in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, slips: int = SLIPS, entries_per_file: int = ENTRIES_PER_FILE):
        self.spark, self.slips, self.per_file = spark, slips, entries_per_file
        self.path = path or new_path(spark, "history")
        self.segments: list[Segment] = []
        self.version = 0
        self.rows_read = spark.sparkContext.accumulator(0)
        self.compared = spark.sparkContext.accumulator(0)  # texts that were fetched to be compared word by word

    @classmethod
    def open(cls, spark: SparkSession, path: str, **how) -> TextHistory:
        """The history in a folder, as its newest list of segments says."""
        self = cls(spark, path, **how)
        where, root = _open(path)
        lists = sorted(x.path for x in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("segments-") and x.base_name.endswith(".json"))
        if lists:
            with where.open_input_stream(lists[-1]) as f:
                told = json.loads(f.read())
            self.version = told["version"]
            self.segments = [Segment(s["level"], s["path"], s["rows"], [tuple(x) for x in s["files"]]) for s in told["segments"]]
        return self

    def _save(self) -> None:
        where, root = _open(self.path)
        self.version += 1
        name = f"{root}/segments-{self.version:09d}.json"
        with where.open_output_stream(name + ".part") as f:
            f.write(json.dumps({"version": self.version, "segments": [asdict(s) for s in self.segments]}).encode())
        where.move(name + ".part", name)

    def _list(self, level: int, path: str) -> Segment:
        where, root = _open(path)
        scheme = path[: len(path) - len(root)] if path.endswith(root) else ""
        files = sorted(scheme + x.path for x in where.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".parquet"))
        if len(files) <= FOOTERS_AT_ONCE:
            told = [_footer(x) for x in files]
        else:
            of = self.spark.createDataFrame([(x,) for x in files], "path string").repartition(-(-len(files) // FOOTERS_AT_ONCE))

            def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    rows = [_footer(x) for x in batch.column(0).to_pylist()]
                    yield pa.RecordBatch.from_pylist([dict(zip(("path", "lo", "hi", "n"), r)) for r in rows], schema=pa.schema([("path", pa.string()), ("lo", pa.string()), ("hi", pa.string()), ("n", pa.int64())]))

            told = sorted(tuple(r) for r in of.mapInArrow(footers, "path string, lo string, hi string, n long").collect())  # a row a file
        told = [t for t in told if t[3]]
        return Segment(level, path, sum(t[3] for t in told), [t[:3] for t in told])

    def add(self, items: DataFrame) -> None:
        """Take in a batch as a new segment: items (text, exact, ts). Equal items become one, with the earliest moment; null and empty ones
        are left out. Segments of equal level are merged in the same write."""
        slips = self.slips
        cuts: list[tuple[str, int]] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, 2000):
                    key, rec, when, pos, size, bits, letters, body = [], [], [], [], [], [], [], []
                    given = [c.to_pylist() for c in batch.slice(s, 2000).columns]
                    for text, exact, ts, count in zip(*given, letter_counts(given[0])):
                        if exact:
                            made, told, r, n, b, count = [("k|" + text, 0)], [None], record_of("k|" + text), 1, 0, 0
                        else:
                            w = text.split(" ")
                            r, n, b = record_of(text), len(w), signature(w)
                            made = [(record_key(r), 0), *entries_of(text, slips)]
                            told = [text, *[None] * (len(made) - 1)]
                        k = len(made)
                        key += [m[0] for m in made]
                        pos += [m[1] for m in made]
                        rec += [r] * k
                        when += [ts] * k
                        size += [n] * k
                        bits += [b] * k
                        letters += [count] * k
                        body += told
                    made = [key, rec, when, pos, size, bits, letters, body]
                    yield _batch(f"{ENTRY}, range int", [*made, [bisect_right(cuts, x) for x in zip(key, rec)]]) if cuts else _batch(ENTRY, made)

        given = _given(items).groupBy("text", "exact").agg(F.min("ts").alias("ts"))
        level, merged = 0, []
        while self.segments and self.segments[-1].level == level:
            merged.append(self.segments.pop())
            level += 1
        if merged:
            rows = given.mapInArrow(run, ENTRY).unionByName(self.spark.read.schema(ENTRY).parquet(*[s.path for s in merged]))
            parts = max(1, -(-2 * merged[-1].rows // self.per_file))  # equal levels are of about equal size; maxRecordsPerFile bounds the rest
            # equal rows of (key, rec) are in one of the ranges already, so the aggregation needs no shuffle of its own
            rows = rows.repartitionByRange(parts, "key", "rec")
            one = rows.groupBy("key", "rec").agg(*[F.min(c).alias(c) for c in ("ts", "pos", "n", "bits", "letters", "text")]).sortWithinPartitions("key", "rec")
        else:
            # texts of one batch differ, so their entries do. Ranges are cut by the entries of a sample (the least of a hash); repartitionByRange would make all entries twice
            texts = given.select("text", "exact", F.xxhash64("text").alias("_h")).orderBy("_h", "text", "exact").limit(SAMPLE).collect()
            share = (texts[-1]["_h"] + (1 << 63)) / (1 << 64) if len(texts) == SAMPLE else 1.0  # of all texts that is in the sample
            told = sorted((k, record_of("k|" + t)) if e else (k, record_of(t)) for t, e, _ in texts for k, _ in ([("k|" + t, 0)] if e else [(record_key(record_of(t)), 0), *entries_of(t, slips)]))
            rows = len(told) / max(share, 1e-12)
            parts = int(max(rows // self.per_file, min(rows // ENTRIES_PER_TASK, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))) + 1
            cuts = sorted({told[i * len(told) // parts] for i in range(1, parts)}) or [(END, 0)]
            one = given.mapInArrow(run, f"{ENTRY}, range int").repartitionById(len(cuts) + 1, "range").drop("range").sortWithinPartitions("key", "rec")
        path = f"{self.path}/level{level}-{uuid.uuid4().hex[:12]}"
        out = one.write.option("compression", "zstd").option("maxRecordsPerFile", 2 * self.per_file).option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", GROUP_BYTES)
        out.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0").parquet(path)
        self.segments.append(self._list(level, path))
        self._save()
        for s in merged:
            drop_path(self.spark, s.path)

    def _router(self) -> Callable[[list[str]], tuple[list[int], list[int]]]:
        """For keys of searches: the index of each and the number of each file that it may be met in."""
        begins = [int(x) for x in np.cumsum([0, *(len(s.files) for s in self.segments)])]
        shared = self.spark.sparkContext.broadcast((begins, [[f[1] for f in s.files] for s in self.segments], [[f[2] for f in s.files] for s in self.segments]))  # a row a file

        def route(keys: list[str]) -> tuple[list[int], list[int]]:
            at, to = [], []
            for i, key in enumerate(keys):
                hi = above(key)
                for b, low, top in zip(*shared.value):
                    for k in range(bisect_left(top, key), bisect_left(low, hi)):
                        at.append(i)
                        to.append(b + k)
            return at, to

        return route

    def _spread(self, routed: DataFrame) -> DataFrame:
        """Searches in order of file and key, spread by a hash of file and asking record, so that neither a file nor a key that many ask for is one task."""
        salts = max(1, -(-(self.segments[-1].rows >> self.segments[-1].level) // SEARCHES_PER_TASK))  # by the size of the newest batch
        return routed.repartition("file", F.pmod(F.col("q"), F.lit(salts))).sortWithinPartitions("file", "key")

    def repeats(self, items: DataFrame) -> DataFrame:
        """(text, exact, first_ts) of those of the items (text, exact, ts) that repeat one taken in before their latest ts: its moment, the
        earliest if several. Exact items repeat equal ones only."""
        asking = _given(items).groupBy("text", "exact").agg(F.max("ts").alias("last"))
        if not self.segments:
            return asking.limit(0).select("text", "exact", F.col("last").alias("first_ts"))
        slips, read, compared = self.slips, self.rows_read, self.compared
        names = self.spark.sparkContext.broadcast([f[0] for s in self.segments for f in s.files])
        route = self._router()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, 5000):
                    key, a, size, n, bits, letters, q, last = [], [], [], [], [], [], [], []
                    given = [c.to_pylist() for c in batch.slice(s, 5000).columns]
                    for text, exact, until, count in zip(*given, letter_counts(given[0])):
                        if exact:
                            made, r, length, b, count = [("k|" + text, 0, 1)], record_of("k|" + text), 1, 0, 0
                        else:
                            w = text.split(" ")
                            made, r, length, b = searches_of(text, slips), record_of(text), len(w), signature(w)
                        k = len(made)
                        key += [m[0] for m in made]
                        a += [m[1] for m in made]
                        size += [m[2] for m in made]
                        n += [length] * k
                        bits += [b] * k
                        letters += [count] * k
                        q += [r] * k
                        last += [until] * k
                    at, to = route(key)
                    rows = pa.array(at, pa.int32())
                    made = _batch(ASKED.removesuffix(", file int"), [key, a, size, n, bits, letters, q, last])
                    yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in made.columns], pa.array(to, pa.int32())], names=[*made.schema.names, "file"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[str, SortedFile] = {}
            for file, part in _by_file(batches):
                rows, left, right = look_up(names.value[file], part, ["rec", "ts", "pos", "n", "bits", "letters"], cache)
                read.add(rows.num_rows)
                rec, ts, pos, n, bits, letters = (rows.column(c).to_numpy() for c in ("rec", "ts", "pos", "n", "bits", "letters"))
                a, size, qn, qbits, qletters, q, last = (part.column(c).to_numpy() for c in ("a", "size", "n", "bits", "letters", "q", "last"))
                bits, qbits = bits.view(np.uint64), qbits.view(np.uint64)
                width = right - left
                ends = np.cumsum(width)
                for b in range(0, int(ends[-1]), 1_000_000):  # what a hot stretch meets comes in bounded pieces
                    hit = np.arange(b, min(b + 1_000_000, int(ends[-1])))
                    i = np.searchsorted(ends, hit, side="right")
                    k = left[i] + hit - (ends[i] - width[i])
                    # what every repeat fulfils: earlier, about as long, the stretch about in its place, few words on one side only
                    near = (ts[k] < last[i]) & (np.abs(n[k] - qn[i]) <= SHIFT)
                    near &= (size[i] == 0) | (np.abs(pos[k] - a[i]) <= SHIFT) & (np.bitwise_count(qbits[i] & ~bits[k]) <= slips + 1) & (np.bitwise_count(bits[k] & ~qbits[i]) <= slips + 1)
                    i, k = i[near], k[near]
                    # texts of as many words, without slipped fillers, differ by two letters a slip
                    near = (n[k] != qn[i]) | (letters[k] == 0) | (qletters[i] == 0) | (letters_apart(letters[k], qletters[i]) <= 2 * slips)
                    i, k = i[near], k[near]
                    yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(rec[k]), pa.array(size[i].astype(np.int64)), pa.array(ts[k]), pa.array(qn[i])], names=["q", "rec", "size", "ts", "n"])

        met = self._spread(asking.mapInArrow(cut, ASKED)).mapInArrow(search, "q long, rec long, size long, ts long, n int")
        met = met.groupBy("q", "rec").agg(F.sum("size").alias("covered"), F.min("ts").alias("ts"), F.min("n").alias("n"))
        number = _numbered(asking)
        met = met.join(number, "q").withColumn("same", (F.col("q") == F.col("rec")) & (F.col("covered") >= F.col("n")))
        key = F.concat(F.lit("r|"), F.lpad(F.lower(F.hex(F.col("rec").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0"))
        wanted = met.select(key.alias("key"), "q", "ts", "same", "text", "exact")

        def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Routes of the records to be read; those that are the same text need none and get file -1."""
            for batch in batches:
                same = batch.column("same").to_numpy(zero_copy_only=False)
                free, other = np.flatnonzero(same), np.flatnonzero(~same)
                at, to = route(batch.column("key").take(pa.array(other)).to_pylist())
                rows = pa.array(np.concatenate([free, other[at] if at else other[:0]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array([-1] * len(free) + to, pa.int32())], names=[*batch.schema.names, "file"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[str, SortedFile] = {}
            for file, part in _by_file(batches):
                mine, exact, ts = (part.column(c).to_pylist() for c in ("text", "exact", "ts"))
                keep = list(range(part.num_rows))
                if file >= 0:
                    rows, left, right = look_up(names.value[file], part, ["text"], cache)
                    read.add(rows.num_rows)
                    compared.add(int((right - left).sum()))
                    body = rows.column("text").to_pylist()
                    split = [x.split(" ") for x in mine]
                    keep = [i for i in keep if any(body[k] is not None and same_headline(split[i], body[k].split(" "), slips) for k in range(left[i], right[i]))]
                yield _batch("text string, exact boolean, ts long", [[x[i] for i in keep] for x in (mine, exact, ts)])

        told = self._spread(wanted.mapInArrow(seek, "key string, q long, ts long, same boolean, text string, exact boolean, file int")).mapInArrow(verify, "text string, exact boolean, ts long")
        return told.groupBy("text", "exact").agg(F.min("ts").alias("first_ts"))


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _given(items: DataFrame) -> DataFrame:
    return items.filter(F.col("text") != "").select("text", F.coalesce("exact", F.lit(False)).alias("exact"), "ts")


def _numbered(asking: DataFrame) -> DataFrame:
    """(q, text, exact) of the asking items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, exact = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield _batch("q long, text string, exact boolean", [[record_of("k|" + t if e else t) for t, e in zip(text, exact)], text, exact])

    return asking.select("text", "exact").mapInArrow(run, "q long, text string, exact boolean")


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of one file each."""
    for batch in batches:
        file = batch.column("file").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield int(file[s]), batch.slice(s, e - s)


def canonical_rows(rows: DataFrame, row_id: str, ts: str, title: str, words_of: Callable[[], Callable[[str | None], list[str]]]) -> DataFrame:
    """(id, ts, text): the canonical text of each row, null where it has none. words_of() is called once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of()
        for batch in batches:
            texts = [" ".join(words(t)) or None for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "ts", "text"])

    return rows.select(F.col(row_id).cast("long").alias("id"), F.col(ts).alias("ts"), F.col(title).alias("title")).mapInArrow(run, "id long, ts long, text string")
