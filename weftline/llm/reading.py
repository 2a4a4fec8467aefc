"""Reading level: smoothed unigram language models, one per band."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.cleaning import words

MAX_REFS = 20_000  # labelled passages that are read at most, by smallest id
SMOOTHING = 0.5
MIN_WORDS = 60
ENGLISH_SHARE = 0.5


@dataclass
class LevelModels:
    """Log probabilities of the known words by band; bands in ascending order."""

    bands: list[int]
    vocabulary: dict[str, int]
    log_prob: np.ndarray
    prior: np.ndarray

    def level(self, tokens: list[str]) -> int | None:
        """The band of highest posterior; ties go to the easier band. None without known words."""
        ids = [i for i in map(self.vocabulary.get, tokens) if i is not None]
        return self.bands[int(np.argmax(self.log_prob[ids].sum(axis=0) + self.prior))] if ids else None


def fit(passages: list[tuple[str | None, int]], smoothing: float = SMOOTHING, min_passages: int = 2) -> LevelModels:
    """Models from labelled passages. Words of a single passage (names, mostly) say nothing of a level and are left
    out. Unseen words of a band get the smoothing count. Empty passages are ignored."""
    bands = sorted({b for _, b in passages})
    seen: dict[str, int] = {}
    split = [(words(t), b) for t, b in passages]
    for w, _ in split:
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= min_passages and not w.isdigit()))}
    counts = np.full((len(vocabulary), len(bands)), smoothing)
    for w, b in split:
        k = bands.index(b)
        for x in w:
            if x in vocabulary:
                counts[vocabulary[x], k] += 1
    share = np.array([sum(b == x for _, b in passages) for x in bands], dtype=float)
    return LevelModels(bands, vocabulary, np.log(counts / counts.sum(axis=0)), np.log(share / share.sum()))


def english_words(text: str | None, models: LevelModels, share: float = ENGLISH_SHARE) -> list[str]:
    """Words of the lines of running English: lines in which at least that share of the words is known to the models (numbers don't count). Tables, code,
    encoded data and other languages have few."""
    if not text:
        return []
    out: list[str] = []
    known = models.vocabulary
    for line in text.split("\n"):
        w = words(line)
        letters = [x for x in w if not x.isdigit()]
        if letters and sum(x in known for x in letters) >= share * len(letters):
            out += w
    return out


def read_models(refs: DataFrame, ref_id: str, text: str, band: str, max_refs: int = MAX_REFS) -> LevelModels:
    """Models from a table of labelled passages, of which at most max_refs are read; rows without text or band are skipped."""
    rows = refs.filter(F.col(text).isNotNull() & F.col(band).isNotNull()).orderBy(ref_id).limit(max_refs).select(text, band).collect()
    return fit([(r[0], int(r[1])) for r in rows])


def assign_levels(docs: DataFrame, doc_id: str, text: str, models: LevelModels, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, band, n_words) of each document with at least min_words words of running English; no shuffle.

    Whole texts are read. Null, empty, short, foreign and non-running texts give no row; repeated
    rows stay repeated; without labelled passages there are no rows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, bands, sizes = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = english_words(t, m) if t and len(t) >= 2 * min_words else []
                if len(w) >= min_words and (b := m.level(w)) is not None:
                    ids.append(i)
                    bands.append(b)
                    sizes.append(len(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands, pa.int64()), pa.array(sizes, pa.int64())], names=[doc_id, "band", "n_words"])

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias("_text")).mapInArrow(run, f"`{doc_id}` long, band long, n_words long")
