"""Evaluation passages inside training documents: rarity-ordered shingle join and window verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.cleaning import words
from weftline.operators.materialize import materialize

SHINGLE = 5  # words
STRETCH = 20  # words of an item in one stretch that make a case
EDITS_PER_WORD = 1 / 7  # "about one word in eight": 20 words may have up to 2 or 3
NEED = 2  # shingles of a stretch that edits and one seam leave whole at least
DENSE = 13  # words of a stretch in runs of three that the item has
SEAM = 64  # empty words between texts that are searched together
COVER = SHINGLE + NEED - 1  # words that NEED whole shingles cover in a stretch at least: those next to each other
TEXTS_AT_ONCE = 256
MAX_ITEMS = 200_000  # items that go to every executor at once


def shingle_hashes(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of size words, in order."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class WordIds:
    """Words to 32-bit hashes, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        w = words(text)
        known = self.known
        ids = list(map(known.get, w))
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            ids[at] = xxhash.xxh32_intdigest(w[at])
            if len(known) > 1_000_000:
                known.clear()
            known[w[at]] = ids[at]
        return np.array(ids, dtype=np.uint32)


@dataclass
class Items:
    """The item side: word ids of each item, and an inverted list of the shingles that count as necessary."""

    ids: list[int]
    word_ids: list[np.ndarray]
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted distinct shingles
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # list of keys[k] is [starts[k], starts[k + 1])
    owner: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # index of the item
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # word position in the item
    prefix: np.ndarray = field(default_factory=lambda: np.empty(0, bool))  # belongs to a necessary prefix of a window
    bits: np.ndarray = field(default_factory=lambda: np.zeros(1, bool))  # low ends of the keys
    triples: dict[int, np.ndarray] = field(default_factory=dict)  # sorted hashes of an item's runs of three words


def index_items(rows: list[tuple[int, str | None]]) -> Items:
    w = WordIds()
    items = Items([r[0] for r in rows], [w.of(r[1]) for r in rows])
    hs = [shingle_hashes(x) for x in items.word_ids]
    flat = np.concatenate(hs) if hs else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(hs), dtype=np.int32), [len(h) for h in hs])
    place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hs]) if hs else np.empty(0, np.int32)
    order = np.argsort(flat, kind="stable")
    items.keys, first = np.unique(flat[order], return_index=True)
    items.starts = np.append(first, len(flat)).astype(np.int64)
    items.owner, items.place = owner[order], place[order]
    items.prefix = np.ones(len(flat), bool)
    items.bits = np.zeros(1 << max(10, int(16 * len(items.keys)).bit_length()), bool)
    items.bits[items.keys & np.uint64(len(items.bits) - 1)] = True
    return items


def mark_prefixes(items: Items, counts: np.ndarray, need: int = NEED, stretch: int = STRETCH + 4) -> None:
    """In every window of stretch words (those of a case and the words that its edits add), order the shingles by how often the corpus has them, rarest first. A text that keeps
    need of them must have one of all but the need - 1 most common: the necessary prefix."""
    rank = np.empty(len(items.owner), np.int64)
    rank[:] = np.repeat(counts, np.diff(items.starts))
    items.prefix[:] = False
    by_item = np.lexsort((items.place, items.owner))
    owners = items.owner[by_item]
    for lo, hi in zip(np.flatnonzero(np.diff(owners, prepend=-1)), np.append(np.flatnonzero(np.diff(owners)) + 1, len(owners))):
        at = by_item[lo:hi]
        per = max(1, min(stretch - SHINGLE + 1, len(at)))
        for s in range(len(at) - per + 1):
            win = at[s : s + per]
            items.prefix[win[np.argsort(rank[win], kind="stable")[: max(1, per - need + 1)]]] = True


def hits(ids: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(position in the text, index of the key) of each shingle of the text that some item has. A table of bits
    by the hashes' low ends passes few others on to the search among the keys."""
    h = shingle_hashes(ids)
    if not len(h) or not len(items.keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.uint64(len(items.bits) - 1)
    at = np.flatnonzero(items.bits[h & low])
    k = np.searchsorted(items.keys, h[at])
    k[k == len(items.keys)] = 0
    real = items.keys[k] == h[at]
    return at[real], k[real]


def candidates(at: np.ndarray, key: np.ndarray, items: Items, cover: int = COVER, stretch: int = STRETCH) -> list[tuple[int, int, int]]:
    """(item index, first, last position) of places where whole shingles of one item, a necessary one among them, cover enough words of a
    window of the text. Windows that touch are one place."""
    if not len(at):
        return []
    n = items.starts[key + 1] - items.starts[key]
    entry = np.repeat(items.starts[key] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    owner, pos, rare = items.owner[entry], np.repeat(at, n), items.prefix[entry]
    order = np.lexsort((pos, owner))
    owner, pos, rare = owner[order], pos[order], rare[order]
    new = np.append(True, (owner[1:] != owner[:-1]))
    step = np.where(new, SHINGLE, np.minimum(SHINGLE, np.diff(pos, prepend=pos[:1])))  # words that a hit adds
    total = np.cumsum(step)
    room = stretch + 4 - SHINGLE
    group = owner.astype(np.int64) * (1 << 40) + pos
    left = np.searchsorted(group, group - room)
    same = np.searchsorted(owner, owner)
    left = np.maximum(left, same)
    covered = total - total[left] + SHINGLE
    good = covered >= cover
    if not good.any():
        return []
    some_rare = np.cumsum(rare)
    out: list[tuple[int, int, int]] = []
    for e in np.flatnonzero(good).tolist():
        s = int(left[e])
        if some_rare[e] - (some_rare[s - 1] if s else 0) == 0:
            continue
        o, a, b = int(owner[e]), int(pos[s]), int(pos[e]) + SHINGLE
        if out and out[-1][0] == o and a <= out[-1][2] + stretch:
            out[-1] = (o, out[-1][1], max(out[-1][2], b))
        else:
            out.append((o, a, b))
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest common run of words first, then the longest among the words still free, down to runs of least
    words; (position in doc, position in item, length). Each word of either side is used once, in whatever order the parts stand."""
    same = doc[:, None] == item[None, :]
    out = []
    while True:
        run = same.astype(np.int16)
        best = 0
        # run[i, j]: length of the common run that ends at i, j
        for i in range(1, len(doc)):
            run[i, 1:] = np.where(same[i, 1:], run[i - 1, :-1] + 1, 0)
        best = int(run.max()) if run.size else 0
        if best < least:
            return sorted(out)
        i, j = np.unravel_index(int(run.argmax()), run.shape)
        a, b = int(i) - best + 1, int(j) - best + 1
        out.append((a, b, best))
        same[a : a + best, :] = False
        same[:, b : b + best] = False


def holds(doc: np.ndarray, item: np.ndarray, stretch: int = STRETCH, edits: float = EDITS_PER_WORD) -> bool:
    """Whether doc (a piece of a document around a candidate place) holds the whole item, or stretch words of it in one stretch.

    Tiles are taken in the document's order; single words between tiles that follow each other on both sides count as kept as
    well. A stretch is a run of tiles; its errors are the words of the document that no tile has, or, where the
    item's parts follow each other, the item's words left out, whichever are more."""
    found = tiles(doc, item)
    if not found:
        return False
    spans = []  # (doc start, doc end, kept, errors before this tile since the one before)
    for n, (a, b, size) in enumerate(found):
        if not n:
            spans.append((a, a + size, size, 0))
            continue
        pa_, pb, ps = found[n - 1]
        gap_d, gap_i = a - pa_ - ps, b - pb - ps
        if 0 <= gap_i <= stretch // 2:
            inner = len(_common(doc[pa_ + ps : a], item[pb + ps : b]))
            errors = max(gap_d, gap_i) - inner
        else:
            inner, errors = 0, gap_d
        spans.append((a, a + size, size + inner, errors))
    whole = min(len(item), stretch)
    for s in range(len(spans)):
        kept = errors = 0
        for e in range(s, len(spans)):
            kept += spans[e][2] if e > s else spans[e][1] - spans[e][0]
            errors += spans[e][3] if e > s else 0
            if kept + errors >= whole and errors <= edits * (kept + errors):
                return True
    return False


def _common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """A longest common subsequence of two short runs."""
    if not len(a) or not len(b):
        return []
    best: list[list[int]] = [[] for _ in range(len(b) + 1)]
    for x in a.tolist():
        before = best[:]
        for j, y in enumerate(b.tolist()):
            best[j + 1] = before[j] + [x] if x == y else max(before[j + 1], best[j], key=len)
    return best[-1]


def dense(piece: np.ndarray, triples: np.ndarray, need: int = DENSE, stretch: int = STRETCH) -> bool:
    """Whether some stretch of the piece has enough words in runs of three that the item has, too: edits of one word in eight leave
    a stretch of 20 words 17 or more kept ones, few of which stand in runs of under three."""
    h = shingle_hashes(piece, 3)
    if not len(h) or not len(triples):
        return False
    k = np.minimum(np.searchsorted(triples, h), len(triples) - 1)
    m = triples[k] == h
    c = np.zeros(len(piece) + 1, np.int32)
    c[1:-2] |= m
    c[2:-1] |= m
    c[3:] |= m
    c = np.cumsum(c)
    n = min(stretch, len(piece))
    return bool((c[n:] - c[:-n]).max() >= need)


def leaked(ids: np.ndarray, at: np.ndarray, key: np.ndarray, starts: np.ndarray, items: Items) -> set[tuple[int, int]]:
    """(text, item) indexes of the items that texts hold. ids has the texts one after the other, each followed by SEAM empty
    words, so that no window reaches over two; text n begins at starts[n]."""
    out = set()
    pad = STRETCH + 4
    for o, a, b in candidates(at, key, items):
        n = int(np.searchsorted(starts, a, side="right")) - 1
        if (n, o) in out:
            continue
        item = items.word_ids[o]
        if o not in items.triples:
            items.triples[o] = np.unique(shingle_hashes(item, 3))
        lo, hi = max(int(starts[n]), a - pad), b + pad
        if n + 1 < len(starts):
            hi = min(hi, int(starts[n + 1]) - SEAM)
        if not dense(ids[lo:hi], items.triples[o]):
            continue
        step = 2 * max(len(item), 100)
        for s in range(lo, hi, step):  # long places in overlapping pieces, each longer than two items
            if holds(ids[s : min(hi, s + 2 * step)], item):
                out.add((n, o))
                break
    return out


def joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with SEAM empty words after each, and where each begins."""
    gap = np.zeros(SEAM, np.uint32)
    starts = np.append(0, np.cumsum([len(x) + SEAM for x in arrays])).astype(np.int64)
    return (np.concatenate([y for x in arrays for y in (x, gap)]) if arrays else gap[:0]), starts[:-1]


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id) of each document that holds a passage of an item.

    Items go to every executor in blocks of max_items, one block for a usual table; each block is one
    pass over the corpus, which is read into arrays of word ids that are
    written to the shared folder; shingle frequencies are counted over all documents and
    collected for the items' shingles only. No shuffle of documents. Null and empty texts and
    items hold nothing, an item filed twice counts under both ids, repeated documents give repeated rows."""
    rows = items.filter(F.length(item_text) > 0).select(item_id, item_text).toLocalIterator()
    found = None
    while block := [(r[0], r[1]) for r in islice(rows, max_items)]:
        one = _of_block(docs, doc_id, text, block, item_id)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else _of_block(docs.limit(0), doc_id, text, [], item_id)


def _of_block(docs: DataFrame, doc_id: str, text: str, block: list[tuple[int, str]], item_id: str) -> DataFrame:
    spark = docs.sparkSession
    index = index_items(block)
    first = spark.sparkContext.broadcast(index)

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = WordIds()
        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(s, TEXTS_AT_ONCE)
                arrays = [w.of(t) for t in part.column(1).to_pylist()]
                flat, starts = joined(arrays)
                at, key = hits(flat, first.value)
                bounds = np.searchsorted(at, np.append(starts, len(flat)))
                n = np.diff(bounds)
                at = at - np.repeat(starts, n)
                keep = np.flatnonzero(n >= NEED)
                if not len(keep):
                    continue
                lists = [[arrays[i].view(np.int32) for i in keep], [at[bounds[i] : bounds[i + 1]].astype(np.int32) for i in keep], [key[bounds[i] : bounds[i + 1]].astype(np.int32) for i in keep]]
                cols = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in xs])).astype(np.int32)), pa.array(np.concatenate(xs))) for xs in lists]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), *cols], names=[doc_id, "w", "p", "k"])

    texts = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    arrays = materialize(texts.mapInArrow(to_ids, f"`{doc_id}` long, w array<int>, p array<int>, k array<int>"), "words")
    counts = np.zeros(len(index.keys), np.int64)
    for r in arrays.select(F.explode(F.array_distinct("k")).alias("k")).groupBy("k").count().collect():  # as many rows as the items have shingles
        counts[r[0]] = r[1]
    mark_prefixes(index, counts)
    ready = spark.sparkContext.broadcast(index)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = ready.value
        for batch in batches:
            for s in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(s, TEXTS_AT_ONCE)
                w, p, k = ([np.asarray(x.values) for x in part.column(c)] for c in (1, 2, 3))
                flat, starts = joined([x.view(np.uint32) for x in w])
                at = np.concatenate([x + y for x, y in zip(p, starts)])
                found = sorted(leaked(flat, at, np.concatenate(k), starts, it))
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[n] for n, _ in found], pa.int64()), pa.array([it.ids[o] for _, o in found], pa.int64())], names=[doc_id, item_id])

    return arrays.select(doc_id, "w", "p", "k").mapInArrow(verify, f"`{doc_id}` long, `{item_id}` long")
