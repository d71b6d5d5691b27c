"""Problem 2: noise in text from scanned pages.

Lines at page edges that come again under a folding which makes misread and right
characters alike, or that hold the title, are running lines; lines of nothing but the
page's number are page numbers. What remains is joined over line and page ends by
dehyphenation rules that ask the corpus vocabulary, and a rare word whose folding is
that of a far more frequent one is put right.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.corpus import current_documents
from quillspark.runtime import checkpoint, ship

#: Lines from either end of a page that may be running lines or page numbers.
EDGE = 3
#: A word is misread if its folding is that of a word so many times as frequent, and seen so often at least.
TIMES, LEAST_SEEN = 8, 3
#: Words of fewer characters are never put right: their foldings are shared by too many words.
LEAST_LETTERS = 3
#: Share of a template's occurrences that must be at page edges for a running line.
EDGE_SHARE = 0.8

# What scanning makes of characters; each is folded to one common form.
FOLDS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j",
    "l": "i", "1": "i", "!": "i", "|": "i", "†": "t", "0": "o", "5": "s", "q": "9", "g": "9",
    "m": "rn", "w": "vv", "d": "ci", "h": "ii", "u": "ii", "л": "ji", "к": "i<",
    "г": "r", "ч": "4", "з": "3", "é": "6", "б": "6", "z": "2", "ш": "iii", "ю": "io", "b": "8", "ы": "8i",
}
PAGE_WORDS = "page pages стр страница сторінка стор seite página pagina pág p s of из із з von de sur sobre".split()
HYPHENS = "-‐‑¬­"

_FOLD = str.maketrans(FOLDS)
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"\d+")
_EDGES = " .,;:!?…«»\"„“”()[]{}¿¡'’|*~—–"
#: What surrounds a word, as patterns: an exclamation mark before one is a misread letter.
_LEAD, _TRAIL = r"""[ .,;:?…«»"„“”()\[\]{}¿¡'’|*~—–]*""", r"""[ .,;:!?…«»"„“”()\[\]{}¿¡'’|*~—–]*"""
#: Small letters that are misread as capitals, so that a word's case doesn't show.
_CASELESS = ("III", "JI", "IO", "I<")
_CODE = re.compile(r"[A-Z]{1,4}-\d[\dA-Z]*|\w*[./]\w*|v?\d[\d.,:/-]*", re.I)
_MARKER = re.compile(r"\s*##\s*page\s*(\d+)\s*", re.I)
_PAGE_MARK = re.compile(r"\s*##\s*(\S+)\s*(\S+)\s*")
_ROMAN = {"i": 1, "v": 5, "x": 10, "c": 100}


def fold(text: str) -> str:
    """One form for all texts that scanning may confuse."""
    return " ".join(text.lower().split()).translate(_FOLD)


_PAGE_FOLDS = {fold(w) for w in PAGE_WORDS}


def template(line: str) -> str:
    """Folding of a line without the numbers that stand alone in it."""
    kept = [t for t in line.split() if not _DIGITS.fullmatch(t.strip(_EDGES + "-"))]
    return fold(" ".join(t for t in kept if t.strip(_EDGES + "-"))).strip(" |*~-")


def _roman(text: str) -> int | None:
    values = [_ROMAN.get(c) for c in text]
    if not text or None in values:
        return None
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0]))


def _number(token: str) -> set[int]:
    """Page numbers that a token may stand for, misread digits included."""
    out = set()
    digits = token.translate(str.maketrans("lIiOoSsZzЗзБбBg|!", "11100552233668911"[:17]))
    if digits.isdigit():
        out.add(int(digits))
    r = _roman(token.lower().replace("l", "i").replace("1", "i").replace("!", "i"))
    if r and not token.isdigit():
        out.add(r)
    return out


def is_page_number(line: str, page: int) -> bool:
    """Does the line hold only the number of the page, in any style, possibly with the page count?"""
    if len(line) > 40 or not line.strip():
        return False
    numbers = []
    for token in re.findall(r"[^\s/\[\]()~*—–]+", line):
        core = token.strip("-.,:|")
        if not core:
            continue
        n = _number(core)
        if fold(core) in _PAGE_FOLDS and not core.isdigit() and not (n and line.strip("-~[]* ").lower() == core.lower()):
            continue
        if not n:
            return False
        numbers.append(n)
    if not numbers or len(numbers) > 2 or page not in numbers[0]:
        return False
    return len(numbers) == 1 or max(numbers[1]) >= page


def _lines(pages: DataFrame) -> DataFrame:
    """One row for each line that isn't blank: its place from either end and its template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        names = ["document_id", "page_number", "line_no", "from_end", "line", "template", "is_number"]
        for batch in batches:
            out: list[tuple] = []
            for doc, page, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines = [x for x in body.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
                n = len(lines)
                for k, x in enumerate(lines):
                    edge = k < EDGE or n - 1 - k < EDGE
                    out.append((doc, page, k, n - 1 - k, x, template(x), edge and is_page_number(x, page)))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = pages.where(F.col("body").isNotNull() & F.col("document_id").isNotNull() & F.col("page_number").isNotNull())
    schema = "document_id string, page_number int, line_no int, from_end int, line string, template string, is_number boolean"
    return rows.select("document_id", "page_number", "body").distinct().mapInArrow(run, schema)


def _titles(loaded: DataFrame) -> DataFrame:
    """``(document_id, title)``: the folded titles under which a document was delivered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([template(t) for t in batch.column(1).to_pylist()], pa.string())], ["document_id", "title"])

    rows = loaded.select(F.col("metadata.id").alias("document_id"), F.col("metadata.title").alias("title")).where("title is not null")
    return rows.distinct().mapInArrow(run, "document_id string, title string").distinct()


def classified_lines(pages: DataFrame, loaded: DataFrame) -> DataFrame:
    """Lines of all pages with ``kind``: running, pageno or body."""
    lines = checkpoint(_lines(pages))
    at_edge = (F.col("line_no") < EDGE) | (F.col("from_end") < EDGE)
    outer = (F.col("line_no") < 2) | (F.col("from_end") < 2)
    by_document = lines.where(at_edge & (F.col("template") != "")).groupBy("document_id", "template").agg(F.countDistinct("page_number").alias("pages"))
    by_template = lines.groupBy("template").agg(
        F.count_if(outer).alias("outer"), F.count("*").alias("all"), F.countDistinct(F.when(outer, F.col("document_id"))).alias("documents")
    )
    titles = _titles(loaded).withColumnRenamed("title", "template").withColumn("is_title", F.lit(True))
    joined = (
        lines.join(by_document, ["document_id", "template"], "left").join(by_template, "template", "left").join(titles, ["document_id", "template"], "left")
    )
    share = F.col("outer") >= EDGE_SHARE * F.col("all")
    again = share & ((F.col("pages") >= 2) | (F.col("documents") >= 3))
    looks = at_edge & ~F.col("is_number") & ~F.col("line").rlike(r"^[^\p{L}]*\p{Ll}") & (F.length("template") > 2) & (F.length("line") <= 90) & (F.col("is_title").isNotNull() | again)
    # a running line is at the very edge, but for other running lines and page numbers
    rows = joined.withColumn("off", looks | F.col("is_number"))
    down = Window.partitionBy("document_id", "page_number").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("document_id", "page_number").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    outermost = F.coalesce(F.min("off").over(down), F.lit(True)) | F.coalesce(F.min("off").over(up), F.lit(True))
    kind = F.when(F.col("off") & outermost, F.when(F.col("is_number"), "pageno").otherwise("running")).otherwise("body")
    return rows.withColumn("kind", kind).select("document_id", "page_number", "line_no", "line", "kind")


@lru_cache(maxsize=1 << 17)
def _core(token: str) -> str:
    """A token without surrounding punctuation; an exclamation mark before or inside a word is a misread letter."""
    return token.rstrip(_EDGES).lstrip(_EDGES.replace("!", ""))


def _broken(line: str) -> tuple[str, str] | None:
    """(piece, hyphen) if the line ends in a broken word."""
    text = line.rstrip()
    if len(text) < 2 or text[-1] not in HYPHENS:
        return None
    piece = text[:-1].rpartition(" ")[2]
    return (piece, text[-1]) if piece and (piece[-1].isalnum() or piece[-1] in "!†<") else None


def join_pieces(first: str, hyphen: str, second: str) -> str:
    """The whole word: a code keeps its hyphen, a word loses that of the line end."""
    core = second.strip(_EDGES)
    if hyphen == "-" and core[:1].isdigit() and _core(first).isupper():
        return first + "-" + second
    return first + second


#: Corrections that are handed to every task as one table, at most; beyond that words are joined to them.
MOST_SHIPPED = 200_000

def page_tokens(lines: list[dict], next_line: str | None, last_line: str | None) -> Iterator[tuple[str, str, bool, bool, bool]]:
    """``(token, core, was_broken, starts, ends_paragraph)`` of the body lines of a page, broken words joined where they begin.

    ``next_line`` is the first body line of the next page, ``last_line`` the last one of the page before.
    """
    lines = [x["line"] for x in sorted(lines, key=lambda x: x["line_no"])]
    width = max(map(len, lines), default=0)
    starts = last_line is None or last_line.rstrip()[-1:] in ".!?…"
    skip = last_line is not None and _broken(last_line) is not None
    for k, line in enumerate(lines):
        tokens = line.split()
        if skip:
            tokens = tokens[1:]
        after = lines[k + 1] if k + 1 < len(lines) else next_line
        broken = _broken(line) if after and after.split() else None
        skip = broken is not None
        for j, t in enumerate(tokens):
            whole = broken is not None and j == len(tokens) - 1
            if whole:
                t = join_pieces(broken[0], broken[1], after.split()[0])
            # a page may end in a short line without ending a paragraph
            stop = j == len(tokens) - 1 and not whole and len(line) < 0.75 * width and t[-1] in ".!?…»\"“"
            yield t, _core(t), whole, starts, stop
            starts = t[-1] in ".!?…" or t[-2:-1] in ".!?" and t[-1] in "»”\"“"


def body_pages(lines: DataFrame) -> DataFrame:
    """``(document_id, page_number, lines, next_line, last_line)``: body lines of each page with those that border on them."""
    body = lines.where(F.col("kind") == "body")
    pages = body.groupBy("document_id", "page_number").agg(
        F.collect_list(F.struct("line_no", "line")).alias("lines"), F.min_by("line", "line_no").alias("first_line"), F.max_by("line", "line_no").alias("last_line")
    )
    # the pages of a document meet in order; a page that is missing in between borders on nothing
    order = Window.partitionBy("document_id").orderBy("page_number")
    number = F.col("page_number")
    after = F.when(F.lead(number).over(order) == number + 1, F.lead("first_line").over(order))
    before = F.when(F.lag(number).over(order) == number - 1, F.lag("last_line").over(order))
    return pages.select("document_id", "page_number", "lines", after.alias("next_line"), before.alias("before_line")).withColumnRenamed("before_line", "last_line")


def vocabulary(pages: DataFrame, loaded: DataFrame) -> DataFrame:
    """``(folded, word, seen, capital)``: words of the pages and of the loaded contents, in lower case, with counts.

    Counts are summed in each batch before the shuffle; all texts are counted.
    """
    names = ["folded", "word", "seen", "capital"]

    def counted(texts: Iterator[tuple[str, bool]]) -> pa.RecordBatch:
        # tokens as they stand are counted first, so that the rest is done once for each different one
        seen: Counter[tuple[str, bool]] = Counter()
        for (token, starts), n in Counter(texts).items():
            core = _core(token)
            if len(core) >= LEAST_LETTERS:
                seen[core.lower(), core[:1].isupper() and not starts] += n
        keys = list(seen)
        columns = [[fold(w) for w, _ in keys], [w for w, _ in keys], list(seen.values()), [n if c else 0 for (_, c), n in seen.items()]]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokens(text):
            starts = True
            for t in text.split():
                yield t, starts
                starts = t[-1] in ".!?…"

        for batch in batches:
            yield counted(x for text in batch.column(0).to_pylist() for x in tokens(text))

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield counted((token, starts) for row in zip(*(c.to_pylist() for c in batch.columns)) for token, _, _, starts, _ in page_tokens(*row))

    schema = "folded string, word string, seen bigint, capital bigint"
    texts = loaded.where(F.col("content").isNotNull()).select("content").mapInArrow(of_texts, schema)
    both = texts.unionByName(pages.select("lines", "next_line", "last_line").mapInArrow(of_pages, schema))
    return both.groupBy("folded", "word").agg(F.sum("seen").alias("seen"), F.sum("capital").alias("capital"))


def corrections(vocab: DataFrame) -> DataFrame:
    """``(word, right, right_is_name)``: misread words (lower case) and what they stand for.

    Of the words of one folding the most frequent is right; another is a misreading if it
    is TIMES rarer, or rarer at all and mixes letters with signs or scripts.
    """
    best = vocab.groupBy("folded").agg(F.max_by(F.struct("word", "seen", "capital"), F.struct("seen", "word")).alias("best"))
    clean = r"^[\p{L}\p{M}'’-]+$"
    latin, cyrillic = F.col("word").rlike(r"\p{IsLatin}"), F.col("word").rlike(r"\p{IsCyrillic}")
    odd = ~F.col("word").rlike(clean) | (latin & cyrillic)
    times = F.when(odd, F.lit(1)).otherwise(F.lit(TIMES))
    wrong = (F.col("word") != F.col("best.word")) & (F.col("best.seen") >= F.greatest(F.lit(LEAST_SEEN), F.col("seen") * times))
    code = r"^(v?\d[\d.,:/%-]*|\p{L}{1,4}-\d+\p{L}?|.*[./].*)$"
    usable = F.col("best.word").rlike(clean) & ~F.col("word").rlike(code) & F.col("word").rlike(r"\p{L}")
    rows = vocab.join(best, "folded").where(wrong & usable)
    return rows.select("word", F.col("best.word").alias("right"), (F.col("best.capital") * 2 > F.col("best.seen")).alias("right_is_name"))


def _right_case(wrong: str, right: str, is_name: bool, starts: bool) -> str:
    letters = [c for c in wrong if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    shown = wrong[:1].isalpha() and not wrong.startswith(_CASELESS)
    upper = wrong[:1].isupper() if shown else is_name or starts
    return right[:1].upper() + right[1:] if upper else right


def repaired(pages: DataFrame, loaded: DataFrame, noise_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, tokens): classified lines, and tokens with ``right``, the word put right or null.

    ``noise_only`` leaves out the tokens that are neither broken nor wrong. Up to
    MOST_SHIPPED corrections go to the tasks as a table, so that a page is one row
    throughout; more are joined to the distinct words of each page.
    """
    spark = ship(pages.sparkSession)
    lines = checkpoint(classified_lines(pages, loaded))
    body = checkpoint(body_pages(lines))
    fixes = checkpoint(corrections(checkpoint(vocabulary(body, loaded))))
    names = ["document_id", "page_number", "place", "token", "was_broken", "starts", "ends_paragraph", "right"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    if fixes.count() <= MOST_SHIPPED:
        table = {r["word"]: (r["right"], bool(r["right_is_name"])) for r in fixes.collect()}
        shipped = spark.sparkContext.broadcast(table)
        source = body.withColumn("fixes", F.lit(None).cast("array<struct<word:string,right:string,right_is_name:boolean>>"))
    else:
        shipped = None

        def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, n, w) for d, n, *row in zip(*(c.to_pylist() for c in batch.columns)) for w in {core.lower() for _, core, *_ in page_tokens(*row)}]
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)][:2] + [pa.array(columns[2], pa.string())], ["document_id", "page_number", "word"])

        met = body.mapInArrow(words_of, "document_id string, page_number int, word string").join(fixes, "word")
        own = met.groupBy("document_id", "page_number").agg(F.collect_list(F.struct("word", "right", "right_is_name")).alias("fixes"))
        source = body.join(own, ["document_id", "page_number"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value if shipped is not None else None
        for batch in batches:
            out = []
            for doc, page, *row, own in zip(*(c.to_pylist() for c in batch.columns)):
                fix = known if known is not None else {x["word"]: (x["right"], bool(x["right_is_name"])) for x in own or ()}
                for place, (token, core, broken, starts, ends) in enumerate(page_tokens(*row)):
                    hit = fix.get(core.lower())
                    if hit or broken or not noise_only:
                        out.append((doc, page, place, token, broken, starts, ends, _right_case(core, *hit, starts) if hit else None))
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "document_id string, page_number int, place int, token string, was_broken boolean, starts boolean, ends_paragraph boolean, right string"
    return lines, source.select("document_id", "page_number", "lines", "next_line", "last_line", "fixes").mapInArrow(run, schema)


def found(pages: DataFrame, loaded: DataFrame) -> DataFrame:
    """``(document_id, page_number, kind, item)`` of all noise: hyphen, misread, running, pageno, marker.

    Null bodies have no lines; repeated rows of a page count once, and so does each item of a page.
    """
    lines, tokens = repaired(pages, loaded, noise_only=True)
    edges = f"^{_LEAD}|{_TRAIL}$"
    whole = F.coalesce(F.col("right"), F.regexp_replace("token", edges, ""))
    hyphen = tokens.where("was_broken").select("document_id", "page_number", F.lit("hyphen").alias("kind"), whole.alias("item"))
    misread = tokens.where("right is not null").select("document_id", "page_number", F.lit("misread").alias("kind"), F.col("right").alias("item"))
    noise = lines.where(F.col("kind") != "body").select("document_id", "page_number", "kind", F.col("line").alias("item"))
    right = F.concat(F.lit("## Page "), F.col("page_number").cast("string"))
    fine = F.regexp_replace(F.lower(F.trim(F.regexp_replace("header", r"\s+", " "))), " ", "") == F.regexp_replace(F.lower(right), " ", "")
    marker = pages.where(F.col("header").isNotNull() & (F.trim("header") != "") & ~fine)
    marker = marker.select("document_id", "page_number", F.lit("marker").alias("kind"), right.alias("item"))
    return hyphen.unionByName(misread).unionByName(noise).unionByName(marker).distinct()


def _whole() -> Column:
    """A token with its word put right, in its own punctuation."""
    edges = f"^({_LEAD})(.*?)({_TRAIL})$"
    return F.when(F.col("right").isNull(), F.col("token")).otherwise(
        F.concat(F.regexp_extract("token", edges, 1), F.col("right"), F.regexp_extract("token", edges, 3))
    )


def split_pages(content: str) -> list[tuple[int, str | None, str]]:
    """``(page_number, header, body)`` of a content, parted at its page markers, damaged ones included.

    A marker's number counts if it can be that of a later page; else the page is the next one.
    """
    out: list[tuple[int, str | None, str]] = []
    number, header, lines = 1, None, []
    last = 0
    for line in [*content.replace("\r\n", "\n").replace("\r", "\n").split("\n"), None]:
        mark = line is not None and _PAGE_MARK.fullmatch(line)
        if line is not None and not (mark and fold(mark[1]) == fold("page")):
            lines.append(line)
            continue
        if header is not None or any(x.strip() for x in lines):
            out.append((number, header, "\n".join(lines).strip("\n")))
            last = number
        if line is not None:
            later = {n for n in _number(mark[2]) if n > last}
            number = last + 1 if last + 1 in later or not later else min(later)
            header, lines = line, []
    return out


def all_pages(pages: DataFrame, loaded: DataFrame) -> DataFrame:
    """``(document_id, page_number, header, body)``: page_block, and what pages of the current .pdf contents it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(doc, *page) for doc, text in zip(*(c.to_pylist() for c in batch.columns)) for page in split_pages(text)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["document_id", "page_number", "header", "body"]
    current = current_documents(loaded).where(F.lower("source_path").endswith(".pdf") & F.col("content").isNotNull() & F.col("document_id").isNotNull())
    split = current.select("document_id", "content").mapInArrow(run, "document_id string, page_number int, header string, body string")
    known = pages.where("body is not null").select("document_id", "page_number").distinct()
    return pages.select(*names).unionByName(split.join(known, ["document_id", "page_number"], "left_anti"))


def document_paragraphs(pages: DataFrame, loaded: DataFrame) -> DataFrame:
    """``(document_id, paragraph_no, first_page, last_page, text)``: the repaired paragraphs of each document, from 0.

    A paragraph runs on over page ends, also over pages without body lines, but not over a
    page number that is missing. Paragraphs are counted by pages, so that no task holds
    the words of a whole document.
    """
    ship(pages.sparkSession)
    pages = checkpoint(all_pages(pages, loaded))
    _, tokens = repaired(pages, loaded)
    tokens = checkpoint(tokens)
    key = ["document_id", "page_number"]
    before = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    tokens = tokens.withColumn("within", F.coalesce(F.sum(F.col("ends_paragraph").cast("int")).over(before), F.lit(0)))
    each = tokens.groupBy(*key).agg(F.count_if("ends_paragraph").alias("ends"), F.max_by("ends_paragraph", "place").alias("closed"))
    in_order = Window.partitionBy("document_id").orderBy("page_number")
    # page numbers less places: it changes where a number is missing
    present = pages.select(*key).distinct().withColumn("gap", F.col("page_number") - F.row_number().over(in_order))
    each = each.join(present, key)
    cut = F.coalesce(~F.lag("closed").over(in_order) & (F.lag("gap").over(in_order) != F.col("gap")), F.lit(False))
    each = each.withColumn("cut", cut.cast("int"))
    earlier = F.coalesce(F.sum("ends").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = F.sum("cut").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    starts = each.select(*key, (earlier + cuts).alias("start"))
    rows = tokens.join(starts, key).withColumn("paragraph_no", (F.col("start") + F.col("within")).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "place", _whole().alias("piece"))))
    grouped = rows.groupBy("document_id", "paragraph_no").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), ordered.alias("pieces"))
    return grouped.select("document_id", "paragraph_no", "first_page", "last_page", F.array_join("pieces.piece", " ").alias("text"))


def paragraphs(pages: DataFrame, loaded: DataFrame) -> DataFrame:
    """``(document_id, page_number, text)``: the repaired text of each page, paragraphs parted by blank lines.

    A word broken over a page end stands whole on the page where it begins. Pages without
    body lines have no row.
    """
    _, tokens = repaired(pages, loaded)
    piece = F.concat(_whole(), F.when(F.col("ends_paragraph"), "\n\n").otherwise(" "))
    ordered = F.array_sort(F.collect_list(F.struct("place", piece.alias("piece"))))
    rows = tokens.groupBy("document_id", "page_number").agg(ordered.alias("pieces"))
    text = F.rtrim(F.array_join(F.col("pieces.piece"), ""))
    return rows.select("document_id", "page_number", F.regexp_replace(text, r"\s+$", "").alias("text"))
