"""Interval, nearest and as-of joins of page elements with chunks, all keyed by document first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X


def chunk_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page ``(document_id, page_number, page_start, page_end)`` that a chunk overlaps, half-open on both sides."""
    on = (chunks["document_id"] == pages["document_id"]) & (chunks["start_char_offset"] < pages["page_end"]) & (chunks["end_char_offset"] > pages["page_start"])
    return chunks.join(pages, on).select(chunks["document_id"], "chunk_id", "page_number")


def chunk_sections(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """As-of join: the last heading ``(document_id, at, title)`` at or before each chunk's start, or null.

    Both sides are laid in one order and the title is carried down, so there is one shuffle by document.
    """
    a = headings.select("document_id", F.col("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("chunk_id"), "title")
    b = chunks.select("document_id", F.col("start_char_offset").alias("at"), F.lit(1).alias("kind"), "chunk_id", F.lit(None).cast("string").alias("title"))
    order = Window.partitionBy("document_id").orderBy("at", "kind", "chunk_id")
    rows = a.unionByName(b).withColumn("section", F.last("title", ignorenulls=True).over(order))
    return rows.where("kind = 1").select("document_id", "chunk_id", "section")


#: A page marker: ``## Page 1``, ``[Page 1]`` or ``--- Page 1``.
PAGE = r"(?i)^\s*(?:##\s*Page\s+|\[Page\s+|---\s*Page\s+)(\d+)"
SECTION = r"^#{1,3}\s+(.+)$"


def raw_lines(documents: DataFrame) -> DataFrame:
    """``(document_id, line_no, line, at, length)``: lines parted by line feeds alone, with the offset of each and the content's length."""
    rows = documents.where(F.col("content").isNotNull())
    rows = rows.select("document_id", F.length("content").alias("length"), F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def page_spans(documents: DataFrame) -> DataFrame:
    """``(document_id, page_number, page_start, page_end)``: a page goes from the end of the line before its marker to that before the next.

    A content without markers is page 1.
    """
    lines = raw_lines(documents)
    order = Window.partitionBy("document_id").orderBy("line_no")
    ends = F.last(F.when(X.trim(F.col("line")) != "", F.col("at") + F.length("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.regexp_extract("line", PAGE, 1)
    marks = lines.withColumns({"page_start": F.coalesce(ends, F.lit(0)), "number": number}).where("number <> ''")
    end = F.coalesce(F.lead("page_start").over(order), F.col("length"))
    marks = marks.select("document_id", F.col("number").cast("int").alias("page_number"), "page_start", end.alias("page_end"))
    rest = documents.where("content is not null").join(marks.select("document_id").distinct(), "document_id", "left_anti")
    return marks.unionByName(rest.select("document_id", F.lit(1).alias("page_number"), F.lit(0).alias("page_start"), F.length("content").alias("page_end")))


def chunk_places(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with ``pages``, all page numbers they lie on, and ``section``.

    Pages are those that the offsets overlap, else the first one named in the text, else 1.
    The section is the first heading (of three levels) in the text, else the last one that
    begins in the content before the chunk, as far as it stands before it, else null.
    """
    columns = chunks.columns
    met = chunk_pages(chunks.where("end_char_offset > start_char_offset"), page_spans(documents))
    pages = met.groupBy("chunk_id").agg(F.array_sort(F.collect_set("page_number")).alias("overlapped"))
    named = F.regexp_extract("text", r"(?:##\s*Page\s+|\[Page\s+)(\d+)", 1).try_cast("int")
    lines = raw_lines(documents)
    begins = F.col("at") + F.length(F.regexp_extract("line", r"^#{1,3}\s+.", 0))
    headings = lines.where(F.col("line").rlike(SECTION)).select("document_id", begins.alias("place"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("chunk_id"), F.struct("at", "line").alias("heading"))
    starts = chunks.where("start_char_offset > 0").select(
        "document_id", F.col("start_char_offset").alias("place"), F.lit(1).alias("kind"), "chunk_id", F.lit(None).cast(headings.schema["heading"].dataType).alias("heading")
    )
    order = Window.partitionBy("document_id").orderBy("place", "kind", "chunk_id")
    last = headings.unionByName(starts).withColumn("h", F.last("heading", ignorenulls=True).over(order)).where("kind = 1")
    shown = X.trim(F.regexp_extract(F.substring(F.col("h.line"), F.lit(1), F.col("place") - F.col("h.at")), SECTION, 1))
    sections = last.where("h is not null").select("chunk_id", shown.alias("before"))
    sizes = documents.where("content is not null").select("document_id", F.length("content").alias("size"))
    own = F.nullif(X.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?md)^#{1,3}\s+(.+)$", 1)), F.lit(""))
    rows = chunks.join(pages, "chunk_id", "left").join(sections, "chunk_id", "left").join(sizes, "document_id", "left")
    section = F.coalesce(own, F.when(F.col("start_char_offset") <= F.col("size"), F.col("before")))
    return rows.select(*columns, F.coalesce("overlapped", F.array(F.coalesce(named, F.lit(1)))).alias("pages"), section.alias("section"))


def attach_elements(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(document_id, element_id, chunk_id, level)``: each element to exactly one chunk of its document, by the first level that finds one.

    Levels: 1 the offset, if above 0, lies in the chunk, its end included; 2 the chunk's
    text has the element's id or its content; 3 the chunk's section is the element's, or
    its text has it; 4 the chunk lies on the element's page; 5 any chunk. Texts are compared
    without regard to case. Within a level the lower index wins, in the last two the one
    whose start is nearest first if the element has an offset above 0. ``elements`` has
    (document_id, element_id, page_number, section_heading, start_char_offset, content),
    ``chunks`` those of ``chunk_places``. Every chunk of a document may hold a mention, so
    that each element meets all chunks of its own document.
    """
    e, c = elements.alias("e"), chunks.alias("c")
    met = e.join(c, "document_id")
    offset, text = F.coalesce("e.start_char_offset", F.lit(0)), F.lower(F.coalesce("c.text", F.lit("")))
    inside = (offset > 0) & offset.between(F.col("c.start_char_offset"), F.col("c.end_char_offset"))
    content, heading = F.coalesce("e.content", F.lit("")), F.coalesce("e.section_heading", F.lit(""))
    mention = F.contains(text, F.lower("e.element_id")) | (content != "") & F.contains(text, F.lower(content))
    section = (X.trim(heading) != "") & ((F.lower("c.section") == F.lower(heading)) | F.contains(text, F.lower(heading)))
    page = F.array_contains("c.pages", F.col("e.page_number"))
    level = F.lit(5)
    for n, found in ((4, page), (3, section), (2, mention), (1, inside)):
        level = F.when(F.coalesce(found, F.lit(False)), n).otherwise(level)
    gap = F.when((F.col("level") >= 4) & (F.col("offset") > 0), F.abs(F.col("c.start_char_offset") - F.col("offset"))).otherwise(0)
    best = F.min_by(F.struct("c.chunk_id", F.col("level")), F.struct("level", gap, "c.chunk_index"))
    rows = met.withColumns({"level": level, "offset": offset})
    return rows.groupBy("document_id", "e.element_id").agg(best.alias("b")).select("document_id", "element_id", "b.chunk_id", "b.level")


def element_addition(text: Column, kind: Column, element_id: Column, content: Column) -> Column:
    """What an element adds to a chunk's text: a mark with its id and its content; empty if that is blank or there already.

    There is a ``Figure`` whose mark or caption the text has, and a ``Table`` of which it
    has the mark, the whole or the first line.
    """
    low, is_table = F.lower(text), kind == "Table"
    mark = F.concat(F.lit("["), kind, F.lit(" "), element_id, F.lit("]"))
    first = F.get(F.filter(F.transform(F.split(content, "\n"), X.trim), lambda x: x != ""), 0)
    there = F.contains(low, F.lower(mark)) | F.contains(low, F.lower(content)) | is_table & F.contains(low, F.lower(first))
    addition = F.concat(F.lit("\n\n"), mark, F.when(is_table, F.lit("\n")).otherwise(F.lit(" ")), content)
    return F.when((X.trim(F.coalesce(content, F.lit(""))) == "") | there, F.lit("")).otherwise(addition)


def augmented(chunks: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their elements' additions after the text: figures, then tables, each in the order of ``element_no``.

    Columns of the chunks, ``figures`` and ``tables``. ``elements`` are those of
    ``attach_elements`` with (kind, element_no). A null text counts as empty if it gets any.
    """
    placed = chunk_places(chunks, documents)
    found = attach_elements(elements, placed).select("document_id", "element_id", "chunk_id")
    named = elements.select("document_id", "element_id", "kind", "element_no", "content").join(found, ["document_id", "element_id"])
    each = named.join(chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("t")), "chunk_id")
    added = element_addition(F.col("t"), F.col("kind"), F.col("element_id"), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("kind", "element_no", "element_id", added.alias("added"))))
    counts = (F.count_if(F.col("kind") == "Figure").alias("figures"), F.count_if(F.col("kind") == "Table").alias("tables"))
    grown = each.groupBy("chunk_id").agg(F.array_join(F.transform(parts, lambda x: x["added"]), "").alias("added"), *counts)
    text = F.when(F.coalesce("added", F.lit("")) != "", F.concat(F.coalesce("text", F.lit("")), "added")).otherwise(F.col("text"))
    rest = [F.col(c) for c in chunks.columns if c not in ("chunk_id", "text")]
    zero = (F.coalesce(n, F.lit(0)).alias(n) for n in ("figures", "tables"))
    return chunks.join(grown, "chunk_id", "left").select("chunk_id", *rest, text.alias("text"), *zero)


def nearest_chunk(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk whose start is nearest to each element; the lower index among equals."""
    met = elements.alias("e").join(chunks.alias("c"), "document_id")
    gap = F.abs(F.col("e.start_char_offset") - F.col("c.start_char_offset"))
    return met.groupBy("document_id", "e.element_id").agg(F.min_by("c.chunk_id", F.struct(gap, "c.chunk_index")).alias("chunk_id"))
