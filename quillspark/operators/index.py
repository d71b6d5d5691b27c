"""Index tables and their upkeep: postings, upsert, delete, re-ingest, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.providers import complete


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(term, chunk_id, tf)``: counted within the row, so that the shuffle carries each term of a chunk once."""
    t = X.tokens(F.col(text))
    rows = chunks.select(F.col(key).alias("chunk_id"), F.explode(t).alias("term"))
    return rows.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return chunks.select(F.col(key).alias("chunk_id"), F.size(X.tokens(F.col(text))).cast("bigint").alias("length"))


def corpus_stats(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """One row: number of chunks, of tokens, and the average length."""
    return lengths(chunks, key, text).agg(F.count("*").alias("chunks"), F.sum("length").alias("tokens"), F.avg("length").alias("average"))


def upsert(table: DataFrame, changes: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Rows of ``table`` replaced by those of ``changes`` with the same key, others appended.

    Of several changes of one key the greatest ``order`` wins; without it they must be distinct.
    """
    if order is not None:
        columns = [c for c in changes.columns if c != key]
        latest = changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row"))
        changes = latest.select(key, "row.*").select(*changes.columns)
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def delete(table: DataFrame, ids: DataFrame, key: str = "chunk_id", collection: str | None = None) -> DataFrame:
    """Rows whose key isn't in ``ids``; with ``collection`` those of other collections stay whatever their key."""
    if collection is not None:
        mine = F.coalesce(F.col("collection_name") == collection, F.lit(False))
        return delete(table.where(mine), ids, key).unionByName(table.where(~mine))
    return table.join(ids.select(key).distinct(), key, "left_anti")


def reingest(table: DataFrame, rechunked: DataFrame) -> DataFrame:
    """Replace the chunks of the documents in ``rechunked``: old and new ids go, then the new rows come."""
    changed = rechunked.select("document_id").distinct()
    old = table.join(changed, "document_id", "left_semi").select("chunk_id")
    gone = old.unionByName(rechunked.select("chunk_id")).distinct()
    return delete(table, gone).unionByName(rechunked.select(*table.columns))


def orphans(table: DataFrame, rechunked: DataFrame) -> DataFrame:
    """Ids of chunks of changed documents that are no longer there."""
    changed = rechunked.select("document_id").distinct()
    return table.join(changed, "document_id", "left_semi").join(rechunked.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "document_id")


# What the two strategies that ask a model ask for.
QUESTION_PROMPT = (
    "Сформулируйте {0} кратких и четких вопросов на русском языке, ответы на которые содержатся "
    "в приведенном фрагменте текста. Выводите строго по одному вопросу на строку, без нумерации и вводных слов.\n\nФрагмент текста:\n"
)
SUMMARY_PROMPT = "Составьте краткое резюме следующего фрагмента текста в одном или двух предложениях на русском языке.\n\nФрагмент текста:\n"


def index_rows(chunks: DataFrame, strategy: str = "chunk", chat=None, questions: int = 3) -> DataFrame:
    """``(embed_text, chunk_id)``: what stands for each chunk in the index.

    ``chunk``: its text; ``sub-chunk``: its first sentence, none for a blank text;
    ``query``: a row for each line of the model's reply to a request for ``questions``
    questions; ``summary``: the model's summary, none if that is blank. Null texts count as empty.
    """
    text = F.coalesce("text", F.lit(""))
    if strategy == "chunk":
        return chunks.select(text.alias("embed_text"), "chunk_id")
    if strategy == "sub-chunk":
        first = X.trim(F.regexp_replace(text, r"(?s)(?<=[.!?])(?U:\s+).*$", ""))
        return chunks.select(first.alias("embed_text"), "chunk_id").where("embed_text <> ''")
    if strategy not in ("query", "summary"):
        raise ValueError(f"unknown indexing strategy {strategy}")
    if chat is None:
        raise ValueError(f"the strategy {strategy} needs a chat provider")
    if questions < 1:
        raise ValueError("at least one question is needed")
    prompt = QUESTION_PROMPT.format(questions) if strategy == "query" else SUMMARY_PROMPT
    asked = complete(chunks.select("chunk_id", F.concat(F.lit(prompt), text).alias("prompt")), "prompt", chat)
    reply = X.trim(F.coalesce("reply", F.lit("")))
    lines = F.transform(F.split(reply, "\n"), X.trim) if strategy == "query" else F.array(reply)
    return asked.select(F.explode(lines).alias("embed_text"), "chunk_id").where("embed_text <> ''")


def route_by_extension(documents: DataFrame, strategies: dict[str, str], default: str = "chunk") -> DataFrame:
    """Name of the indexing strategy of each document by the extension of its path."""
    ext = F.lower(F.regexp_extract("source_path", r"(\.[^./]+)$", 1))
    chosen = F.lit(default)
    for e, s in strategies.items():
        chosen = F.when(ext == e, s).otherwise(chosen)
    return documents.withColumn("strategy", chosen)


def first_images(images: DataFrame, least_bytes: int = 1024, least_side: int = 48) -> DataFrame:
    """Images that are large enough, each content once: the first page wins."""
    rows = images.where((F.length("data") >= least_bytes) & (F.col("width") >= least_side) & (F.col("height") >= least_side))
    order = Window.partitionBy("document_id", F.sha2("data", 256)).orderBy("page_number", "image_id")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def large_pngs(images: DataFrame, least_side: int = 120, most_aspect: float = 6.0, least_bytes: int = 4096) -> DataFrame:
    """PNG files by the size in their header, other formats by their bytes; each content once."""
    hexed = F.hex("data")
    png = F.substring(hexed, 1, 16) == "89504E470D0A1A0A"
    side = [F.conv(F.substring(hexed, 33 + 8 * k, 8), 16, 10).cast("bigint") for k in (0, 1)]
    shape = F.greatest(*side) / F.greatest(F.lit(1), F.least(*side))
    keep = F.when(png, (F.least(*side) >= least_side) & (shape <= most_aspect)).otherwise(F.length("data") >= least_bytes)
    rows = images.where(keep)
    order = Window.partitionBy("document_id", F.sha2("data", 256)).orderBy("page_number", "image_id")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
