"""Text expressions: Column in, Column out, evaluated in the JVM.

White space, digits and letters are those of Unicode; trimming takes all white space.
Null stays null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the cleaner deletes, and those it makes a space.
DELETED = "\u00ad\u200b\u200c\u200d\ufeff\u00ae\u2122\u00a9"
SPACED = "\u00a0\u202f"
# Prefixes of embedding prompts by model family and task.
PROMPTS = {
    ("nomic", "document"): "search_document: ", ("nomic", "query"): "search_query: ",
    ("mxbai", "query"): "Represent this sentence for searching relevant passages: ",
}
FNV_OFFSET, FNV_PRIME, SPARSE_SIZE = 2166136261, 16777619, 1_000_000


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_invisible(c: Column) -> Column:
    """Delete soft hyphens, zero-width characters and trade marks; no-break spaces become spaces."""
    return F.translate(c, SPACED + DELETED, " " * len(SPACED))


def normalise_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def dehyphenate(c: Column) -> Column:
    """Join words broken over a line end, then close up what else has a hyphen there, as codes do."""
    words = F.regexp_replace(c, r"(?<=\p{L}{2})[-‐‑]\n(?U:\s*)(?=\p{Ll}{2})", "")
    return F.regexp_replace(words, r"(?<=[A-Za-zА-Яа-я0-9])[-‐‑]\n(?U:\s*)(?=[A-Za-zА-Яа-я0-9])", "-")


def dot_leaders(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:\.(?U:\s*)){3,}", " ")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[^\S\n]{2,}", " "), r"\n{3,}", "\n\n")


def clean(c: Column, leaders: bool = True, hyphens: bool = True, spaces: bool = True) -> Column:
    """The cleaner: invisible characters, newlines, hyphens, dot leaders, white space, trim, in this order; the middle three as asked."""
    c = normalise_newlines(strip_invisible(c))
    if hyphens:
        c = dehyphenate(c)
    if leaders:
        c = dot_leaders(c)
    if spaces:
        c = collapse_whitespace(c)
    return trim(c)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order and with repeats; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{Nd}_]+)"), F.lit(1)), F.array().cast("array<string>"))


def letters(c: Column) -> Column:
    """Number of letters."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def truncate(c: Column, n: int) -> Column:
    flat = F.trim(F.regexp_replace(c, r"[\r\n]+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.left(flat, F.lit(n)), F.lit("...")))


def base64url(c: Column) -> Column:
    """URL-safe base64 without padding."""
    plain = F.regexp_replace(F.base64(c.cast("binary")), r"[\r\n]", "")
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def label(c: Column) -> Column:
    """Letters, digits and underscores of a graph label; ``Unknown`` if none."""
    return F.coalesce(F.nullif(F.regexp_replace(c, r"[^\p{L}\p{Nd}_]", ""), F.lit("")), F.lit("Unknown"))


def slug(c: Column) -> Column:
    """Lower-case letters and digits of any script with hyphens between; ``node`` if none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("node"))


def formal_id(c: Column) -> Column:
    """Canonical id of a section sign, article or RFC at the start of a heading; null if none."""
    section = F.regexp_extract(c, r"^\s*§\s*([\d.]*\d)", 1)
    article = F.regexp_extract(c, r"(?i)^\s*Article\s+(\d+)", 1)
    rfc = F.regexp_extract(c, r"(?i)^\s*RFC\s*(\d+)", 1)
    return (
        F.when(section != "", F.concat(F.lit("S"), section)).when(article != "", F.concat(F.lit("Art"), article)).when(rfc != "", F.concat(F.lit("RFC"), rfc))
    )


def references(c: Column) -> Column:
    """Canonical ids of all formal references in a text, distinct, in order of appearance."""
    found = F.regexp_extract_all(c, F.lit(r"(§\s*[\d.]*\d|(?i:Article\s+\d+|RFC\s*\d+))"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), formal_id), lambda x: x.isNotNull()))


def prompt(c: Column, model: str, task: str) -> Column:
    prefix = next((p for (family, t), p in PROMPTS.items() if family in model.lower() and t == task), "")
    return F.concat(F.lit(prefix), c)


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over the code points of a text."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.expr("0L") + F.ascii(x))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * FNV_PRIME).bitwiseAND(F.lit(4294967295).cast("bigint")))


def column_index(c: Column) -> Column:
    """0-based index of a spreadsheet column name or cell reference: A is 0, AA is 26."""
    name = F.regexp_extract(F.upper(c), "^([A-Z]+)", 1)
    codes = F.transform(F.filter(F.split(name, ""), lambda x: x != ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(codes, F.lit(0), lambda n, x: n * 26 + x) - 1


def parse_score(c: Column, default: float = 0.5) -> Column:
    """First number of a reply, comma or point, held to 0..1; ``default`` if there is none."""
    number = F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)", 1)
    value = number.try_cast("double")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.least(value, F.lit(1.0)))


def cache_key(ids: Column) -> Column:
    """SHA-256 of the distinct ids, sorted and joined by NUL."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), "\0"), 256)


def figure_caption(c: Column) -> Column:
    """First caption of a figure on a page: ``Рис. 3 ...`` or ``Figure 3 ...`` up to the line's end; null if none."""
    found = F.regexp_extract(c, r"(?m)^\s*((?:Рис\.|Рисунок|Figure|Fig\.)\s*\d+[^\n]*)", 1)
    return F.nullif(trim(found), F.lit(""))


def numbered_heading(line: Column) -> Column:
    """``1.2 Title`` as a markdown heading one level deeper for each dot; other lines as they are."""
    number = F.regexp_extract(line, r"^\s*(\d+(?:\.\d+)*)\.?\s+\p{Lu}", 1)
    depth = F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."))) + 2)
    short = (number != "") & (F.length(line) <= 120) & ~line.rlike(r"[.;,]\s*$")
    return F.when(short, F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), trim(line))).otherwise(line)
