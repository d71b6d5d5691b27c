"""Problem 6: token budget by source, language and domain, kept up to date.

A count table maps the hash of a content and that of the tokenizer to a number of
tokens. Only contents that it doesn't hold are encoded. The cube is kept through signed
deltas: an item that is new adds, one that is gone subtracts, one that changed does both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.corpus import current_documents
from quillspark.llm.encode import slices
from quillspark.llm.language import label_names
from quillspark.runtime import checkpoint, new_folder, ship

DIMENSIONS = ["corpus", "source", "language", "department", "document_type"]
HASH = ["h1", "h2", "tokenizer"]
UNKNOWN = "unknown"
#: In place of a vocabulary's path: the tokenizer whose tokens are the bytes of UTF-8.
BYTES = "bytes"
#: What was delivered in the last so many days is the change that a registered query applies to an older state.
LATE_DAYS = 30

# Spellings of the departments, by their letters alone.
DEPARTMENTS = {
    "engineering": "Engineering", "eng": "Engineering", "hr": "HR", "humanresources": "HR", "legal": "Legal", "legaldept": "Legal",
    "product": "Product", "products": "Product", "finance": "Finance", "fin": "Finance",
}
# The document types.
TYPES = ["ADR", "Contract", "Policy", "Reference", "ReleaseNote", "Report", "Runbook", "Specification", "Ticket"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key] if table else F.lit(None).cast("string")


def department(c: Column) -> Column:
    """One spelling for each department; null and blank are UNKNOWN, an unlisted one stays as it is, trimmed."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    return F.coalesce(_lookup(DEPARTMENTS, letters), F.nullif(F.trim(c), F.lit("")), F.lit(UNKNOWN))


def document_type(c: Column) -> Column:
    """One spelling for each type; null and blank are UNKNOWN, an unlisted one stays as it is, trimmed."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]", "")
    return F.coalesce(_lookup({t.lower(): t for t in TYPES}, letters), F.nullif(F.trim(c), F.lit("")), F.lit(UNKNOWN))


def language(c: Column, names: dict[str, str]) -> Column:
    """Code of language_ref that a label names; UNKNOWN if none."""
    text = F.lower(F.trim(c))
    return F.coalesce(_lookup(names, text), _lookup(names, F.trim(F.regexp_replace(text, "[-_].*", ""))), F.lit(UNKNOWN))


def tokenizer_hash(path: str) -> int:
    """A signed 64-bit hash of the vocabulary file; 0 for BYTES."""
    if path == BYTES:
        return 0
    with open(path, "rb") as f:
        return int.from_bytes(hashlib.sha256(f.read()).digest()[:8], "big", signed=True)


def with_hash(rows: DataFrame, path: str) -> DataFrame:
    """128 bits of the text and the tokenizer's hash; a null text hashes as the empty one."""
    text = F.coalesce("text", F.lit(""))
    return rows.withColumns({"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("second"), text), "tokenizer": F.lit(tokenizer_hash(path))})


def counts_of(rows: DataFrame, path: str) -> DataFrame:
    """``(h1, h2, tokenizer, tokens)`` of ``(h1, h2, tokenizer, text)``; copies in a batch are encoded once."""
    if path == BYTES:
        return rows.groupBy(*HASH).agg(F.coalesce(F.octet_length(F.first("text")), F.lit(0)).cast("bigint").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            first: dict[tuple[int, int], int] = {}
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                first.setdefault(key, i)
            keep = pa.array(list(first.values()), pa.int64())
            texts = batch.column(3).take(keep).to_pylist()
            n = [len(r) // 4 for a, b in slices(texts) for r in encoder.encode_batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(keep) for k in range(3)), pa.array(n, pa.int64())], [*HASH, "tokens"])

    out = rows.select(*HASH, "text").mapInArrow(run, "h1 bigint, h2 bigint, tokenizer bigint, tokens bigint")
    return out.dropDuplicates(HASH)


@dataclass
class State:
    """What is known after a run: token counts, items with their hash and dimensions, finest cells of the cube."""

    counts: DataFrame
    items: DataFrame
    cells: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> State:
        """The state that ``update`` wrote under ``folder``, in this run or an earlier one."""
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in ("counts", "items", "cells")))


def update(rows: DataFrame, before: State | None = None, path: str | None = None, folder: str | None = None) -> State:
    """State of the items ``rows`` (DIMENSIONS, key, text), each (corpus, key) once; written under ``folder`` if there is one.

    Without ``before`` everything is new. Items of ``before`` that are missing in ``rows``
    count as removed. Cells whose items are all gone disappear.
    """
    spark = ship(rows.sparkSession)
    path = path or bpe.tokenizer_path()

    def kept(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return checkpoint(df)
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    hashed = with_hash(rows, path)
    fresh = hashed if before is None else hashed.join(before.counts.select(*HASH), HASH, "left_anti")
    counts = counts_of(fresh, path)
    if before is not None:
        counts = before.counts.select(*HASH, "tokens").unionByName(counts)
    counts = kept(counts, "counts")
    columns = ["corpus", "key", *DIMENSIONS[1:], *HASH]
    items = kept(hashed.select(*columns), "items")
    signed = items.withColumn("sign", F.lit(1))
    if before is not None:
        # an item that stayed as it was cancels itself out
        old = before.items.select(*columns).withColumn("sign", F.lit(-1))
        signed = signed.unionByName(old).groupBy(*columns).agg(F.sum("sign").alias("sign")).where(F.col("sign") != 0)
    # summed by cell and content first, so that many copies of one content meet its count once
    grouped = signed.groupBy(*DIMENSIONS, *HASH).agg(F.sum("sign").alias("items"))
    deltas = grouped.join(counts, HASH).groupBy(*DIMENSIONS).agg(F.sum("items").alias("items"), F.sum(F.col("items") * F.col("tokens")).alias("tokens"))
    if before is not None:
        deltas = deltas.unionByName(before.cells).groupBy(*DIMENSIONS).agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    # the cells come last: they complete a state
    return State(counts, items, kept(deltas.where(F.col("items") != 0), "cells"))


def cube(cells: DataFrame) -> DataFrame:
    """Totals of every combination of dimensions within a corpus; a dimension that is summed over is null.

    ``level`` has a bit for each dimension summed over: 8 source, 4 language, 2 department, 1 type.
    """
    rows = cells.cube(*DIMENSIONS).agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.grouping_id().cast("int").alias("level"))
    return rows.where(F.col("level") < 16)


def chunk_items(chunks: DataFrame, loaded: DataFrame, names: dict[str, str]) -> DataFrame:
    """The chunks, each once, with silo, label of their document, department and type."""
    labels = current_documents(loaded.select("metadata", F.lit(None).cast("string").alias("content"), "source_path", "lang_label", "loaded_at"))
    first = [F.first(c).alias(n) for c, n in (("document_id", "document_id"), ("text", "text"), ("metadata", "metadata"))]
    rows = chunks.groupBy("chunk_id").agg(*first).join(labels.select("document_id", "lang_label"), "document_id", "left")
    return rows.select(
        F.lit("chunks").alias("corpus"), F.col("chunk_id").alias("key"), F.coalesce("metadata.silo", F.lit(UNKNOWN)).alias("source"),
        language(F.col("lang_label"), names).alias("language"), department(F.col("metadata.department")).alias("department"),
        document_type(F.col("metadata.document_type")).alias("document_type"), "text",
    )


def document_items(documents: DataFrame, names: dict[str, str]) -> DataFrame:
    return documents.select(
        F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("key"), F.coalesce("source", F.lit(UNKNOWN)).alias("source"),
        language(F.col("lang"), names).alias("language"), department(F.col("department")).alias("department"),
        document_type(F.col("document_type")).alias("document_type"), "text",
    )


def all_items(chunks: DataFrame, loaded: DataFrame, documents: DataFrame, names: dict[str, str]) -> DataFrame:
    return chunk_items(chunks, loaded, names).unionByName(document_items(documents, names))


def run(spark: SparkSession, steps: list[DataFrame], path: str | None = None) -> State:
    """State after the items of each step, each a whole set of items; every state is written and read again by the next."""
    state, folder = None, new_folder(spark, "token-budget")
    for number, items in enumerate(steps):
        update(items, state, path, f"{folder}/{number}")
        state = State.read(spark, f"{folder}/{number}")
    return state


def _earlier(rows: DataFrame, at: str) -> DataFrame:
    """Rows of before the last LATE_DAYS; those without a time are earlier ones."""
    last = rows.agg(F.max(at) - F.make_dt_interval(F.lit(LATE_DAYS))).scalar()
    return rows.where(F.coalesce(F.col(at) < last, F.lit(True)))


def token_budget(spark: SparkSession, chunks: DataFrame, loaded: DataFrame, documents: DataFrame, reference: DataFrame) -> DataFrame:
    """The cube of both corpora: the state of LATE_DAYS ago, then the signed deltas of what came or changed since.

    A chunk belongs to the older state if its document was delivered by then, under the
    label that it had then. The result is that of a count of everything from the start.
    """
    names = label_names(reference)
    before = _earlier(loaded, "loaded_at")
    known = before.select(F.col("metadata.id").alias("document_id")).distinct()
    old = all_items(chunks.join(known, "document_id", "left_semi"), before, _earlier(documents, "crawled_at"), names)
    return cube(run(spark, [old, all_items(chunks, loaded, documents, names)]).cells)


def after_removal(spark: SparkSession, chunks: DataFrame, loaded: DataFrame, documents: DataFrame, reference: DataFrame, withdrawn: DataFrame, path: str = BYTES) -> DataFrame:
    """The cube after three states: earlier deliveries, all of them, and all but the chunks of the ``withdrawn`` documents (document_id).

    The tokens are those of ``path``, by default the bytes of UTF-8, which SQL can count too.
    """
    names = label_names(reference)
    first = all_items(chunks, _earlier(loaded, "loaded_at"), _earlier(documents, "crawled_at"), names)
    left = chunks.join(withdrawn.select("document_id").distinct(), "document_id", "left_anti")
    return cube(run(spark, [first, all_items(chunks, loaded, documents, names), all_items(left, loaded, documents, names)], path).cells)
