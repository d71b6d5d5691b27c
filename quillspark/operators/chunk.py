"""Chunkers: one document row becomes rows of ``(key, chunk_index, text, start_char_offset, end_char_offset)``.

Those with a closed form are array expressions in the JVM. Offsets are code points, end
exclusive. Null and empty texts have no chunks; blank pieces are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vector import cosine
from quillspark.runtime import ship

#: Separators of the recursive chunker, in order.
SEPARATORS = ["\n## ", "\n# ", "\n\n", "\n", ". ", " "]
CUT = "\u0001"


def _rows(df: DataFrame, key: str, pieces: Column) -> DataFrame:
    """Explode an array of structs (start, text) in order; index counts the pieces that are not blank."""
    filled = F.filter(pieces, lambda p: F.regexp_replace(p["text"], r"(?U)\s+", "") != "")
    out = df.select(F.col(key), F.posexplode(filled).alias("chunk_index", "p"))
    end = (F.col("p.start") + F.length("p.text")).alias("end_char_offset")
    return out.select(key, "chunk_index", F.col("p.text").alias("text"), F.col("p.start").cast("int").alias("start_char_offset"), end.cast("int").alias("end_char_offset"))


def fixed_size(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` that advance by ``size - overlap``; the last one reaches the end. Nothing is trimmed or dropped."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the size")
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    rows = df.where(n > 0).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    piece = F.substring(F.col(text), start + 1, F.lit(size))
    return rows.select(key, "chunk_index", piece.alias("text"), start.alias("start_char_offset"), (start + F.length(piece)).alias("end_char_offset"))


def _spans(parts: Column) -> Column:
    """Contiguous strings with their starts."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,text:string>>)").alias("out"))

    def step(acc, p):
        return F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), p.alias("text")))).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def _trimmed(span: Column) -> Column:
    lead = F.length(span["text"]) - F.length(F.regexp_replace(span["text"], r"(?U)^\s+", ""))
    return F.struct((span["start"] + lead).alias("start"), F.regexp_replace(span["text"], r"(?U)^\s+|\s+$", "").alias("text"))


def split_sentences(c: Column) -> Column:
    """Sentences with the white space after them: a final mark, white space, then a capital or a digit."""
    return F.split(F.regexp_replace(c, r"(?<=[.!?])([ \t\r\n]+)(?=[\p{Lu}0-9])", "$1" + CUT), CUT)


def sentence_groups(df: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """``size`` sentences to a chunk, trimmed."""
    parts = split_sentences(F.col(text))
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("s") / F.lit(float(size))).cast("int") - 1)), lambda i: F.array_join(F.slice(F.col("s"), i * size + 1, F.lit(size)), "")
    )
    rows = df.where(F.length(text) > 0).select(key, parts.alias("s")).select(key, F.transform(_spans(groups), _trimmed).alias("p"))
    return _rows(rows, key, F.col("p"))


def _cut_after(parts: Column, separator: str, limit: int) -> Column:
    def cut(p):
        return F.when(F.length(p) <= limit, F.array(p)).otherwise(F.split(F.replace(p, F.lit(separator), F.lit(separator + CUT)), CUT))

    return F.flatten(F.transform(parts, cut))


def _hard_cut(parts: Column, limit: int) -> Column:
    def cut(p):
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(p) - 1) / F.lit(float(limit))).cast("int")))
        return F.transform(starts, lambda i: F.substring(p, i * limit + 1, F.lit(limit)))

    return F.flatten(F.transform(parts, cut))


def recursive(df: DataFrame, key: str, text: str, limit: int = 800, separators: list[str] | None = None) -> DataFrame:
    """Split what is over the limit after every occurrence of one separator, then of the next; small pieces are not merged."""
    parts = F.array(F.col(text))
    for s in separators or SEPARATORS:
        parts = _cut_after(parts, s, limit)
    rows = df.where(F.length(text) > 0).select(key, _hard_cut(parts, limit).alias("parts"))
    rows = rows.select(key, F.transform(_spans(F.col("parts")), _trimmed).alias("p"))
    return _rows(rows, key, F.col("p"))


def words(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """Greedy packing when every word counts one token: ``size`` words to a chunk, joined by spaces."""
    w = F.filter(F.split(F.col(text), r"[ \t\r\n]+"), lambda x: x != "")
    rows = df.select(key, w.alias("w")).where(F.size("w") > 0)
    rows = rows.select(key, "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / F.lit(float(size))).cast("int"))).alias("chunk_index"))
    return rows.select(key, "chunk_index", F.array_join(F.slice("w", F.col("chunk_index") * size + 1, F.lit(size)), " ").alias("text"))


def regex_token_count(text: str) -> int:
    """The offline counter: runs of letters, up to three digits, or signs. It is no public tokenizer."""
    return len(re.findall(r"[^\W\d_]+|\d{1,3}|[^\w\s]+|_+", text))


def token_budget(
    chunks: DataFrame, limit: int = 512, counter: Callable[[str], int] = regex_token_count, reindex: bool = True, suffix_ids: bool = False
) -> DataFrame:
    """Split the texts over ``limit`` tokens by packing words greedily; a single word over it stays whole.

    ``chunks`` has (chunk_id, document_id, chunk_index, text, start_char_offset, end_char_offset). Offsets of
    pieces lie within their parent's. ``reindex`` numbers the chunks of a document anew and derives ids from
    that; ``suffix_ids`` keeps the index and adds ``.n`` to the id from the second piece on.
    """
    ship(chunks.sparkSession)

    def pack(text: str) -> Iterator[tuple[int, str]]:
        if counter(text) <= limit:
            yield 0, text
            return
        start, end, held = None, 0, ""
        for m in re.finditer(r"\S+", text):
            longer = text[start : m.end()] if start is not None else m[0]
            if start is not None and counter(longer) > limit:
                yield start, held
                start, longer = None, m[0]
            if start is None:
                start = m.start()
            held, end = longer, m.end()
        if start is not None:
            yield start, text[start:end]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if not r.text:
                    continue
                span = r.end_char_offset - r.start_char_offset
                for n, (at, piece) in enumerate(pack(r.text)):
                    a, b = r.start_char_offset + min(at, span), r.start_char_offset + min(at + len(piece), span)
                    name = f"{r.chunk_id}.{n}" if suffix_ids and n else r.chunk_id
                    rows.append((name, r.document_id, r.chunk_index, n, piece, a, b))
            yield pd.DataFrame(rows, columns=["chunk_id", "document_id", "chunk_index", "piece", "text", "start_char_offset", "end_char_offset"])

    source = chunks.select("chunk_id", "document_id", "chunk_index", "text", "start_char_offset", "end_char_offset")
    schema = "chunk_id string, document_id string, chunk_index int, piece int, text string, start_char_offset int, end_char_offset int"
    out = source.mapInPandas(run, schema)
    return reindexed(out, ["chunk_index", "piece"]).drop("piece") if reindex else out.drop("piece")


def reindexed(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Contiguous chunk_index from 0 in each document, and ids that follow it."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(*order)) - 1
    out = chunks.withColumn("chunk_index", place.cast("int"))
    return out.withColumn("chunk_id", F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")))


def semantic_islands(sentences: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Join neighbouring sentences ``(document_id, sentence_no, text, vector)`` while their cosine is at least ``threshold``."""
    order = Window.partitionBy("document_id").orderBy("sentence_no")
    similar = F.round(cosine(F.lag("vector").over(order), F.col("vector")), 6)
    rows = sentences.withColumn("breaks", F.when((F.col("sentence_no") == F.min("sentence_no").over(order)) | (similar < threshold), 1).otherwise(0))
    rows = rows.withColumn("chunk_index", (F.sum("breaks").over(order) - 1).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_no", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("document_id", "chunk_index").agg(text.alias("text"), F.count("*").alias("sentences"))


def context_window(content: Column, start: Column, end: Column) -> Column:
    """What a contextual chunker shows of the document: all of it up to 8000 characters, else its beginning and the chunk's surroundings."""
    low = F.greatest(F.lit(0), start - 2750)
    near = F.concat(F.left(content, F.lit(2500)), F.lit("\n[...]\n"), F.substring(content, low + 1, end + 2750 - low))
    return F.when(F.length(content) <= 8000, content).when(low <= 2500, F.left(content, F.lit(8000))).otherwise(near)


def code_declarations(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """One chunk for each type or method of C#-like code, nested members again by themselves; other files are one chunk.

    Declarations are found by a scanner over braces, not by a compiler. Each chunk is led
    by the usings, the namespace and the header of the enclosing type.
    """
    ship(df.sparkSession)
    declared = re.compile(
        r"^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|async|override|virtual|readonly)\s+)*"
        r"(?:(class|record|struct|interface|enum)\s+(\w+)[^{;]*|[\w<>\[\],.?]+\s+(\w+)\s*\([^)]*\)[^{;=]*)\{",
        re.M,
    )

    def close(source: str, at: int) -> int:
        depth = 0
        for i in range(at, len(source)):
            depth += (source[i] == "{") - (source[i] == "}")
            if not depth:
                return i + 1
        return len(source)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, source, name in zip(pdf["key"], pdf["text"], pdf["path"]):
                if not source:
                    continue
                if not str(name).endswith(".cs"):
                    rows.append((k, 0, None, source, 0, len(source)))
                    continue
                head = "\n".join(re.findall(r"^\s*(?:using [^;]+;|namespace [\w.]+)", source, re.M))
                spans = [(m.start(), close(source, m.end() - 1), m) for m in declared.finditer(source)]
                for n, (a, b, m) in enumerate(spans):
                    outer = [x[2][0].strip(" \t\r\n{") for x in spans if x[2][1] and x[0] < a and b <= x[1]]
                    rows.append((k, n, m[2] or m[3], "\n".join(filter(None, [head, *outer, source[a:b].strip("\n")])), a, b))
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "name", "text", "start_char_offset", "end_char_offset"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(path).alias("path"))
    return rows.mapInPandas(run, f"key {kind}, chunk_index int, name string, text string, start_char_offset int, end_char_offset int").withColumnRenamed("key", key)


def atomic_tables(df: DataFrame, key: str, text: str, rows_a_piece: int = 20) -> DataFrame:
    """Cut markdown at headings, lead each part by its heading path, and split tables by rows under their repeated header."""
    ship(df.sparkSession)

    def parts(source: str) -> Iterator[str]:
        path: list[tuple[int, str]] = []
        held: list[str] = []

        def flush() -> Iterator[str]:
            crumb = " > ".join(t for _, t in path)
            table = [x for x in held if x.lstrip().startswith("|")]
            other = "\n".join(x for x in held if not x.lstrip().startswith("|")).strip()
            if other:
                yield f"{crumb}\n{other}" if crumb else other
            for i in range(2, max(3, len(table)), rows_a_piece) if len(table) > 2 else ():
                piece = "\n".join(table[:2] + table[i : i + rows_a_piece])
                yield f"{crumb}\n{piece}" if crumb else piece
            held.clear()

        for line in source.split("\n"):
            m = re.match(r"(#{1,6})\s+(.*)", line)
            if m:
                yield from flush()
                path[:] = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            else:
                held.append(line)
        yield from flush()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, p) for k, t in zip(pdf["key"], pdf["text"]) if t for n, p in enumerate(parts(t))]
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "text"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, chunk_index int, text string").withColumnRenamed("key", key)
