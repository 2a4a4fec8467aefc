"""Encoding a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import DEFAULT_PATH, encoder

ROWS_PER_BATCH = 256


def encode_texts(docs: DataFrame, doc_id: str, text: str, path: str = DEFAULT_PATH) -> DataFrame:
    """(doc_id, ids): the ids of every text, one row in and one row out, no shuffle.

    Null and empty texts have the empty list. Texts of any length are encoded whole; a batch is cut
    into slices of a few hundred rows, whose ids go out before the next are made, so memory
    follows the longest text and not the partition. Repeated rows stay repeated. Other columns
    are dropped before the Python stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                ids = enc.encode_batch(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[doc_id, "ids"])

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias("_text")).mapInArrow(run, f"`{doc_id}` long, ids array<int>")
