"""Page operators over ``(document_id, content)`` with ``## Page n`` markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import PreprocessOptions
from quillspark.functions import text as X

MARKER = r"(?i)^## Page\s+\d+"
# A line of nothing but the page's number.
PAGE_NUMBER = r"(?iu)^(?:(?:Стр\.?|Page)\s*)?\d+(?:\s*(?:из|of|/)\s*\d+)?$"


def split_lines(documents: DataFrame) -> DataFrame:
    """``(document_id, line_no, line)`` of contents with normalised newlines."""
    lines = F.split(X.normalise_newlines(F.col("content")), "\n")
    return documents.where(F.col("content").isNotNull()).select("document_id", F.posexplode(lines).alias("line_no", "line"))


def split_pages(documents: DataFrame) -> DataFrame:
    """``(document_id, page_index, header, body)``: a marker begins a page; lines before the first, if any, are page 0 without a header.

    Headers and bodies are trimmed. An empty content is one empty page.
    """
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = split_lines(documents).withColumn("is_marker", F.col("line").rlike(MARKER).cast("int"))
    rows = rows.withColumn("page_index", F.sum("is_marker").over(order).cast("int"))
    lines = F.array_sort(F.collect_list(F.when(F.col("is_marker") == 0, F.struct("line_no", "line"))))
    return rows.groupBy("document_id", "page_index").agg(
        X.trim(F.max(F.when(F.col("is_marker") == 1, F.col("line")))).alias("header"), X.trim(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("body")
    )


def strip_running_lines(pages: DataFrame, least_pages: int = 3, share: float = 0.5) -> DataFrame:
    """Remove lines at the page edges that come again on at least half of the pages of a document, and page numbers.

    The first line goes if it, or it but for its digits, is as often the first one; then the
    last of what is left if that holds for last lines, or if it is only the page's number.
    Counted are lines of 3 to 120 characters that begin neither with ``#`` nor ``|``; a
    page of one line counts on both sides. Documents of fewer than ``least_pages`` pages
    stay as they are. ``body`` is joined anew from the lines that aren't blank.
    """
    lines = F.filter(F.transform(F.split("body", "\n"), X.trim), lambda x: x != "")
    size = F.size("lines")
    rows = pages.withColumn("lines", lines).withColumns({
        "pages": F.count("*").over(Window.partitionBy("document_id")),
        "top": F.lower(F.when(size > 0, F.element_at("lines", 1))), "bottom": F.lower(F.when(size > 0, F.element_at("lines", -1))),
    })

    def shape(c):
        return F.regexp_replace(c, r"\d+", "#")

    def often(line, counted):
        # lines are counted by their first and last places in the document; the test is for any line
        fit = counted.isNotNull() & F.length(counted).between(3, 120) & ~counted.startswith("#") & ~counted.startswith("|")
        need = F.ceil(F.col("pages") * share)
        exact = F.count(F.when(fit, 1)).over(Window.partitionBy("document_id", counted)) >= need
        alike = F.count(F.when(fit, 1)).over(Window.partitionBy("document_id", shape(counted))) >= need
        return line.isNotNull() & (exact | alike)

    many = F.col("pages") >= least_pages
    rows = rows.withColumns({"drop_first": many & often(F.col("top"), F.col("top")), "often_last": often(F.col("bottom"), F.col("bottom"))})
    # what is left has a last line of its own unless the only line went
    left = size > F.when(F.col("drop_first"), 1).otherwise(0)
    rows = rows.withColumn("drop_last", many & left & (F.col("often_last") | F.col("bottom").rlike(PAGE_NUMBER)))
    start = F.when(F.col("drop_first"), 2).otherwise(1)
    kept = F.greatest(F.lit(0), size - F.when(F.col("drop_first"), 1).otherwise(0) - F.when(F.col("drop_last"), 1).otherwise(0))
    body = F.when(many, F.array_join(F.slice("lines", start, kept), "\n")).otherwise(F.col("body"))
    return rows.select("document_id", "page_index", "header", body.alias("body"), "drop_first", "drop_last")


def _keeps(options: PreprocessOptions) -> Column:
    body = X.trim(F.col("body"))
    holds = F.col("body").contains("|") | F.col("body").contains("![") | F.col("body").contains("```")
    phrase = F.lower(F.regexp_replace(body, "[.!? ]+$", "")).isin([p.lower() for p in options.phrases])
    return (body != "") & (holds | ~(phrase | (X.letters(F.col("body")) < options.least_letters)))


def keep_pages(pages: DataFrame, options: PreprocessOptions | None = None) -> DataFrame:
    """Drop empty pages, pages of one of the phrases, and those of too few letters; a page with a table, an image or code always stays.

    A phrase is the whole page but for closing marks and letter case.
    """
    return pages.where(_keeps(options or PreprocessOptions()))


def reassemble(pages: DataFrame, keep: Column | None = None) -> DataFrame:
    """``(document_id, content)``: headers and bodies in order, a blank line between pages, trimmed.

    With ``keep`` only the pages for which it holds; a document without any has an empty content.
    """
    head = F.when(F.coalesce("header", F.lit("")) != "", F.concat("header", F.lit("\n"))).otherwise(F.lit(""))
    page = F.struct("page_index", F.concat(head, X.trim(F.col("body")), F.lit("\n")).alias("page"))
    parts = F.array_sort(F.collect_list(page if keep is None else F.when(keep, page)))
    return pages.groupBy("document_id").agg(X.trim(F.array_join(F.transform(parts, lambda x: x["page"]), "\n")).alias("content"))


def preprocess(documents: DataFrame, options: PreprocessOptions | None = None) -> DataFrame:
    """Clean contents; those of two pages or more lose running lines and empty pages, each step as the options say.

    A content of which no page is left is empty; a blank one stays as it is.
    """
    options = options or PreprocessOptions()
    text = X.clean(F.col("content"), leaders=options.dot_leaders, hyphens=options.dehyphenate, spaces=options.clean)
    rows = documents.where(F.col("content").isNotNull()).select("document_id", F.when(X.trim(F.col("content")) == "", F.col("content")).otherwise(text).alias("content"))
    if not (options.strip_running_lines or options.drop_empty_pages):
        return rows
    pages = split_pages(rows).withColumn("n", F.count("*").over(Window.partitionBy("document_id"))).where(F.col("n") > 1).drop("n")
    if options.strip_running_lines:
        pages = strip_running_lines(pages, options.least_pages)
    worked = reassemble(pages, _keeps(options) if options.drop_empty_pages else None)
    joined = rows.join(worked.withColumnRenamed("content", "worked"), "document_id", "left")
    return joined.select("document_id", F.coalesce("worked", "content").alias("content"))


def cluster_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Lines of ``(document_id, page_number, text, left, bottom)`` words: equal baselines after rounding half to even, top first."""
    base = F.bround(F.col("bottom") / tolerance) * tolerance
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    rows = words.withColumn("baseline", base).groupBy("document_id", "page_number", "baseline").agg(joined.alias("line"))
    order = Window.partitionBy("document_id", "page_number").orderBy(F.desc("baseline"))
    return rows.withColumn("line_no", F.row_number().over(order))


def assemble_words(words: DataFrame, separator: str | None = "## Page {0}", tolerance: float = 3.0) -> DataFrame:
    """``(document_id, content)`` of a table of words: lines by their baselines, pages in order, each under its separator.

    ``{0}`` in the separator is the page number; null or blank leaves it out. Pages without
    any word are left out, and so are documents without any.
    """
    lines = cluster_lines(words, tolerance).withColumn("line", X.trim(F.col("line"))).where("line <> ''")
    each = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    pages = lines.groupBy("document_id", "page_number").agg(F.concat(F.array_join(F.transform(each, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
    if separator and separator.strip():
        before, _, after = separator.partition("{0}")
        pages = pages.withColumn("text", F.concat(F.lit(before), F.col("page_number").cast("string") if "{0}" in separator else F.lit(""), F.lit(after + "\n\n"), "text"))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    content = F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")
    return pages.groupBy("document_id").agg(F.regexp_replace(content, r"(?U)\s+$", "").alias("content"))


def markdown_tables(documents: DataFrame) -> DataFrame:
    """Runs of lines that begin and end with a bar: ``(document_id, table_no, section, first_line, lines, markdown)``."""
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = split_lines(documents)
    bar = F.trim("line").startswith("|") & F.trim("line").endswith("|")
    rows = rows.withColumns({
        "is_table": bar, "before": F.coalesce(F.lag(bar).over(order), F.lit(False)),
        "section": F.last(F.when(F.col("line").rlike(r"^#{1,6}\s"), F.regexp_replace("line", r"^#{1,6}\s+", "")), ignorenulls=True).over(order),
    })
    rows = rows.withColumn("table_no", F.sum((F.col("is_table") & ~F.col("before")).cast("int")).over(order)).where("is_table")
    lines = F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line"))))
    return rows.groupBy("document_id", "table_no").agg(
        F.first("section").alias("section"), F.min("line_no").alias("first_line"), F.count("*").alias("lines"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("markdown"),
    )
