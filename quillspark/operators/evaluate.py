"""Quality of chunks, of rankings and of answers, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X

#: Price of a thousand tokens of embedding, prompt and completion.
PRICES = ("0.00", "0.20", "0.40")
#: Weights of the composite score and the bounds of its labels.
WEIGHTS, GOOD, FAIR = (0.25, 0.40, 0.25, 0.10), 0.80, 0.65
# Words that say nothing about a text, and the answer where no sentence holds a fact.
STOP_WORDS = [
    "модуль", "модуля", "модулей", "также", "этого", "может", "быть", "согласно",
    "данным", "документа", "паспорта", "является", "имеет", "следующие", "параметры",
]
NO_ANSWER = "В предоставленном контексте найдены параметры документа, соответствующие запросу."
FAILED = "[ошибка"


def upper_median(c: Column) -> Column:
    """The element at n // 2 of the sorted values, not the mean of the two in the middle."""
    values = F.array_sort(F.collect_list(c))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def size_summary(chunks: DataFrame, group: str, size: str) -> DataFrame:
    """Least, greatest, mean, upper median and population deviation of a size, by group.

    The median comes from the running count of distinct sizes, so that no group's values
    are collected: at most one row for each distinct size.
    """
    n = F.length(size) if chunks.schema[size].dataType.simpleString() == "string" else F.col(size)
    sized = chunks.select(F.col(group).alias("g"), n.cast("bigint").alias("n")).where("n is not null").groupBy("g", "n").agg(F.count("*").alias("c"))
    running = F.sum("c").over(Window.partitionBy("g").orderBy("n"))
    total = F.sum("c").over(Window.partitionBy("g"))
    rows = sized.withColumns({"upto": running, "total": total})
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n")))
    mean = F.sum(F.col("n") * F.col("c")) / F.sum("c")
    square = F.sum(F.col("n") * F.col("n") * F.col("c")) / F.sum("c")
    return rows.groupBy(F.col("g").alias(group)).agg(
        F.sum("c").alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(mean, 6).alias("mean"),
        median.alias("median"), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 6).alias("deviation"),
    )


def histogram(chunks: DataFrame, group: str, text: str) -> DataFrame:
    n = F.length(text)
    return chunks.where(n.isNotNull()).groupBy(group).agg(
        F.count_if(n < 100).alias("under_100"), F.count_if((n >= 100) & (n < 300)).alias("from_100"), F.count_if((n >= 300) & (n < 600)).alias("from_300"),
        F.count_if((n >= 600) & (n <= 1000)).alias("from_600"), F.count_if(n > 1000).alias("over_1000"),
    )


def duplicates(chunks: DataFrame, group: str, text: str) -> DataFrame:
    """Number of chunks whose trimmed text came before: counted by content first, so that copies don't gather."""
    once = chunks.where(F.col(text).isNotNull()).groupBy(group, F.sha2(X.trim(F.col(text)), 256).alias("hash")).agg(F.count("*").alias("c"))
    return once.groupBy(group).agg(F.sum("c").alias("chunks"), F.sum(F.col("c") - 1).alias("duplicates"))


def over_budget(chunks: DataFrame, group: str, tokens: Column, budgets: tuple[int, ...] = (256, 512, 1024)) -> DataFrame:
    return chunks.groupBy(group).agg(*(F.count_if(tokens > b).alias(f"over_{b}") for b in budgets), F.round(100.0 * F.count_if(tokens > budgets[0]) / F.count("*"), 6).alias("share_over"))


def coverage(chunks: DataFrame, documents: DataFrame, edge: int = 10) -> DataFrame:
    """Share of each content that its chunks cover, characters lost, and gaps (at the edges only those over ``edge``).

    Islands of overlapping intervals come from the running greatest end before each chunk.
    """
    order = Window.partitionBy("document_id").orderBy("start_char_offset", "end_char_offset")
    before = F.max("end_char_offset").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.withColumn("before", before)
    hole = F.when(F.col("before").isNull(), F.when(F.col("start_char_offset") > edge, 1).otherwise(0)).when(F.col("start_char_offset") > F.col("before"), 1).otherwise(0)
    fresh = F.greatest(F.lit(0), F.col("end_char_offset") - F.greatest("start_char_offset", F.coalesce("before", F.lit(0))))
    of_document = rows.groupBy("document_id").agg(F.sum(fresh).alias("covered"), F.sum(hole).alias("inner_gaps"), F.max("end_char_offset").alias("reach"))
    joined = documents.select("document_id", F.col("length").alias("length")).join(of_document, "document_id")
    gaps = F.col("inner_gaps") + F.when(F.col("length") - F.col("reach") > edge, 1).otherwise(0)
    return joined.select(
        "document_id", F.col("covered").cast("bigint").alias("covered"), (F.col("length") - F.col("covered")).cast("bigint").alias("lost"), gaps.cast("bigint").alias("gaps"),
        F.round(100.0 * F.col("covered") / F.col("length"), 6).alias("coverage"),
    )


def line_coverage(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Share of the lines of each content that some chunk of it contains; for chunks without valid offsets."""
    lines = documents.select("document_id", F.explode(F.array_distinct(F.transform(F.split("content", "\n"), X.trim))).alias("line")).where("line <> ''")
    met = lines.join(chunks.where("text is not null").select("document_id", "text"), "document_id", "left")
    found = met.groupBy("document_id", "line").agg(F.coalesce(F.bool_or(F.col("text").contains(F.col("line"))), F.lit(False)).alias("found"))
    return found.groupBy("document_id").agg(F.count("*").alias("lines"), F.count_if("found").alias("found"))


def table_integrity(chunks: DataFrame, group: str, text: str) -> DataFrame:
    """Chunks with table rows; those without a separator row; those whose first row is data."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), F.trim), lambda x: x.startswith("|"))
    separator = F.exists("rows", lambda x: x.rlike(r"^\|[\s:|-]*-[\s:|-]*\|$"))
    rows = chunks.where(F.col(text).isNotNull()).select(group, lines.alias("rows")).where(F.size("rows") > 0)
    second = F.when(F.size("rows") > 1, F.element_at("rows", 2).rlike(r"^\|[\s:|-]*-[\s:|-]*\|$")).otherwise(F.lit(False))
    return rows.groupBy(group).agg(F.count("*").alias("tables"), F.count_if(~separator).alias("orphaned"), F.count_if(separator & ~second).alias("broken"))


def boundary_defects(chunks: DataFrame, group: str, text: str) -> DataFrame:
    t = X.trim(F.col(text))
    rows = chunks.where(F.col(text).isNotNull() & (t != "")).select(group, t.alias("t"))
    return rows.groupBy(group).agg(
        F.count("*").alias("chunks"), F.count_if(F.col("t").rlike(r"^\p{Ll}")).alias("starts_lower"),
        F.count_if(F.col("t").rlike(r"^[,.;:!?)]")).alias("starts_mark"), F.count_if(F.col("t").endswith("-")).alias("ends_hyphen"),
    )


def metadata_faults(chunks: DataFrame) -> DataFrame:
    """By document: chunks with a blank id, with an index that isn't their place, with blank metadata id or title."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")) - 1
    rows = chunks.withColumn("place", place)
    return rows.groupBy("document_id").agg(
        F.count_if(blank(F.col("chunk_id"))).alias("blank_ids"), F.count_if(F.col("chunk_index") != F.col("place")).alias("misplaced"),
        F.count_if(blank(F.col("metadata.id"))).alias("blank_metadata_ids"), F.count_if(blank(F.col("metadata.title"))).alias("blank_titles"),
    )


def is_relevant(text: Column, facts: Column, keywords: Column) -> Column:
    """At least two (or all) facts, or at least three (or all) keywords, without regard to case."""
    low = F.lower(text)
    hits = lambda xs: F.size(F.filter(xs, lambda x: F.contains(low, F.lower(x))))
    return ((F.size(facts) > 0) & (hits(facts) >= F.least(F.lit(2), F.size(facts)))) | ((F.size(keywords) > 0) & (hits(keywords) >= F.least(F.lit(3), F.size(keywords))))


def retrieval_metrics(judged: DataFrame) -> DataFrame:
    """Of ``(query_id, rank, relevant)``: one row of recall at 5 and 10, MRR, mean nDCG at 10 and share of queries without a hit.

    nDCG takes 1 as the ideal and is held to 1.
    """
    gain = F.sum(F.when(F.col("relevant") & (F.col("rank") <= 10), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    each = judged.groupBy("query_id").agg(first.alias("first"), F.least(F.lit(1.0), gain).alias("ndcg"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return each.agg(
        F.count("*").alias("queries"), share(F.col("first") <= 5).alias("recall_5"), share(F.col("first") <= 10).alias("recall_10"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg_10"), share(F.col("first").isNull()).alias("zero_hit"),
    )


def grounded_share(answer: Column, context: Column) -> Column:
    """Share of the answer's distinct words of four or more characters that the context has, without regard to case.

    1 without any such word; 0 for a null or blank answer or context.
    """
    found = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"([A-Za-zА-Яа-я0-9\-_:]{4,})"), F.lit(1)), lambda w: F.lower(w)))
    words = F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))
    low = F.lower(context)
    share = F.when(F.size(words) == 0, F.lit(1.0)).otherwise(F.round(F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words), 6))
    blank = (X.trim(F.coalesce(answer, F.lit(""))) == "") | (X.trim(F.coalesce(context, F.lit(""))) == "")
    return F.when(blank, F.lit(0.0)).otherwise(share)


def fact_share(answer: Column, facts: Column) -> Column:
    """Share of the facts that the answer holds; 0 for a null, blank or failed answer, else 1 without facts."""
    low = F.lower(answer)
    share = F.when(F.size(facts) == 0, F.lit(1.0)).otherwise(F.round(F.size(F.filter(facts, lambda f: F.contains(low, F.lower(f)))) / F.size(facts), 6))
    none = (X.trim(F.coalesce(answer, F.lit(""))) == "") | F.coalesce(low, F.lit("")).startswith(FAILED)
    return F.when(none, F.lit(0.0)).otherwise(share)


def extractive_answer(text: Column, facts: Column, sentences: int = 2) -> Column:
    """First sentences, parted by full stops and line ends, that hold an expected fact; NO_ANSWER if none does."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\n]"), X.trim), lambda p: p != "")
    held = F.slice(F.filter(parts, lambda p: F.exists(facts, lambda f: F.contains(F.lower(p), F.lower(f)))), 1, sentences)
    return F.when(F.size(held) > 0, F.concat(F.array_join(held, ". "), F.lit("."))).otherwise(F.lit(NO_ANSWER))


def cost(embedding: Column, prompt: Column, completion: Column) -> Column:
    """Decimal price of the tokens of a request."""
    rate = [F.lit(p).cast("decimal(10,4)") for p in PRICES]
    amount = sum((n.cast("decimal(18,0)") * r for n, r in zip((embedding, prompt, completion), rate)), F.lit(0).cast("decimal(18,4)"))
    return (amount / F.lit(1000).cast("decimal(10,0)")).cast("decimal(18,6)")


def composite(chunk: Column, ndcg: Column, correct: Column) -> Column:
    """Weighted score out of 100; a missing metric counts 0.5, the cost term 1."""
    half = lambda c: F.coalesce(c, F.lit(0.5))
    a, b, c, d = WEIGHTS
    return F.round(100 * (a * half(chunk) + b * half(ndcg) + c * half(correct) + d * 1.0), 6)


def composite_label(score: Column) -> Column:
    return F.when(score >= 100 * GOOD, "good").when(score >= 100 * FAIR, "fair").otherwise("weak")


def markdown_report(title: str, table: DataFrame, order: str) -> str:
    """A report of an aggregate, which is a handful of rows, as a markdown table."""
    rows = table.orderBy(order).collect()
    head = "| " + " | ".join(table.columns) + " |\n|" + " --- |" * len(table.columns)
    return f"# {title}\n\n{head}\n" + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)
