"""Views of the project's tables that several problems share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_documents(loaded: DataFrame) -> DataFrame:
    """``(document_id, content, source_path, lang_label)``: the row of the greatest loaded_at of each metadata.id.

    Rows of equal loaded_at have equal content; the aggregate keeps one row a key before
    the shuffle, so that many deliveries of one document don't gather in one task. A null
    loaded_at counts as the oldest.
    """
    latest = F.max_by(F.struct("content", "source_path", "lang_label"), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")))
    return loaded.groupBy(F.col("metadata.id").alias("document_id")).agg(latest.alias("row")).select("document_id", "row.*")


def distinct_chunks(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Each chunk_id once, with ``columns``; its repeated rows have equal content."""
    rest = [c for c in columns if c != "chunk_id"]
    return chunks.groupBy("chunk_id").agg(*(F.first(c).alias(c) for c in rest)).select(*columns)


def about(key: str, wanted: int, rows: int) -> Column:
    """Condition that keeps about 1.5 times ``wanted`` of ``rows`` rows by the hash of their key, all of them where there are fewer.

    A sample that is then ordered and limited sends the driver its own size, not that size
    from every partition.
    """
    share = 1.5 * wanted / max(rows, 1)
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))
