"""Problem 8: token ids of every text (see bpe.py for the method)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.runtime import ship

#: Texts, and characters, that are encoded together; a longer single text is a slice of its own.
SLICE_ROWS, SLICE_CHARS = 2000, 4_000_000


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (i - start >= SLICE_ROWS or size + n > SLICE_CHARS):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _large_lists(batch: pa.RecordBatch, texts: list[str | None], encoder: bpe.SpeculativeBPE) -> Iterator[pa.RecordBatch]:
    for a, b in slices(texts):
        rows = encoder.encode_batch(texts[a:b])
        offsets = np.zeros(b - a + 1, np.int32)
        np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["key", "ids"])


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, ids)`` of each row: the ids of its text, without special tokens.

    Null and empty texts have the empty list; blank texts have the ids of their white
    space; strings of special tokens are ordinary text. Repeated rows stay repeated;
    no row is dropped. Other columns of ``df`` are ignored, whatever their names.
    """
    ship(df.sparkSession)
    path = path or bpe.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            yield from _large_lists(batch, batch.column(1).to_pylist(), encoder)

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, tokens)`` of each row; null and empty texts have 0 tokens."""
    ship(df.sparkSession)
    path = path or bpe.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [len(r) // 4 for a, b in slices(texts) for r in encoder.encode_batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["key", "tokens"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, tokens bigint").withColumnRenamed("key", key)
