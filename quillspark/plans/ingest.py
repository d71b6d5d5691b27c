"""Queries of filters, cleaning, pages, chunkers and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.predicates import where
from quillspark.functions.vector import cosine
from quillspark.operators import chunk as C
from quillspark.operators import index as I
from quillspark.operators import pages as P
from quillspark.plans.base import CHUNKS, DOCUMENTS, VECTORS, Query, chunks, documents, typed, vectors
from quillspark.runtime import table
from quillspark.sources import facts
from quillspark.sources.facts import document_facts

# -- filters ---------------------------------------------------------------------


def filter_ops(s, d):
    p = where(lambda m: (m.fiscal_year >= 2019) & (m.fiscal_year < 2024) & ~(m.silo == "legal-contracts") | m.title.contains("index"))
    return chunks(s, d).where(p.column()).select("chunk_id", "metadata.silo", "metadata.fiscal_year")


def filter_null_safe(s, d):
    p = where(lambda m: (m.department != "HR") & ~(m.document_type == "Policy") | (m.office == None) & (m.department == None))  # noqa: E711
    return chunks(s, d).where(p.column()).select("chunk_id", "metadata.department", "metadata.document_type")


def filter_in_like(s, d):
    p = where(lambda m: m.silo.isin(["hr-policies", None, "technical-docs"]) & (m.title.startswith("R") | m.title.endswith("e")) | m.silo.isin([]))
    return chunks(s, d).where(p.column()).select("chunk_id", "metadata.title")


def filter_custom(s, d):
    """A Python predicate, evaluated in Arrow batches before anything is cut off."""
    from quillspark.functions.predicates import Custom
    from quillspark.runtime import ship

    ship(s)
    return chunks(s, d).where(Custom(lambda m: (m["title"] or "")[:1].lower() in "aeiou").column()).select("chunk_id", F.col("metadata.title").alias("title"))


# -- cleaning and pages ------------------------------------------------------------


def _hashed(df, *keys, text="content"):
    return df.select(*keys, F.sha2(text, 256).alias("hash"), F.length(text).cast("bigint").alias("length"))


def clean_text(s, d):
    """Everything but dehyphenation, which has its own query."""
    rows = documents(s, d).where("content is not null")
    return _hashed(rows.select("document_id", X.clean(F.col("content"), hyphens=False).alias("content")), "document_id")


def clean_metadata(s, d):
    rows = documents(s, d).select("document_id", X.clean(F.col("metadata.title"), hyphens=False).alias("title"), X.clean(F.col("metadata.author"), hyphens=False).alias("author"))
    return rows


def dehyphenate(s, d):
    rows = documents(s, d).where("content is not null")
    return _hashed(rows.select("document_id", X.dehyphenate(X.normalise_newlines(F.col("content"))).alias("content")), "document_id")


def page_split(s, d):
    return _hashed(P.split_pages(documents(s, d)), "document_id", "page_index", "header", text="body")


def _planted(pages):
    """Pages with what few of the data's have: numbers at the foot of every other page, and filler pages."""
    n = F.col("page_index")
    foot = F.concat("body", F.lit("\nСтр. "), n.cast("string"), F.lit(" из 12"))
    body = F.when(n % 10 == 3, "Для записей.").when(n % 10 == 5, "15").when(n % 10 == 7, "This page intentionally left blank!")
    return pages.withColumn("body", body.when(n % 2 == 0, foot).otherwise(F.col("body")))


def header_footer_strip(s, d):
    """With page numbers planted at the foot of every other page."""
    return _hashed(P.strip_running_lines(_planted(P.split_pages(documents(s, d)))), "document_id", "page_index", "drop_first", "drop_last", text="body")


def page_boilerplate(s, d):
    """Pages that are kept, filler pages planted among them."""
    return P.keep_pages(_planted(P.split_pages(documents(s, d)))).select("document_id", "page_index", X.letters(F.col("body")).cast("bigint").alias("letters"))


def reassemble(s, d):
    return _hashed(P.reassemble(P.split_pages(documents(s, d))), "document_id")


def preprocess(s, d):
    return _hashed(P.preprocess(documents(s, d)), "document_id")


def markdown_tables(s, d):
    return P.markdown_tables(documents(s, d)).select("document_id", F.col("table_no").cast("bigint").alias("table_no"), "first_line", "lines", F.sha2("markdown", 256).alias("hash"))


def _words(s, d):
    """Words of page_block laid on slightly uneven baselines."""
    rows = table(s, d, "page_block").select("document_id", "page_number", "body").distinct()
    lines = rows.select("document_id", "page_number", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line"))
    words = lines.select("document_id", "page_number", "line_no", F.posexplode(F.split("line", " ")).alias("left", "text")).where("text <> ''")
    base = F.lit(9000.0) - F.col("line_no") * 12 + F.pmod(F.col("left"), F.lit(2)) * 0.5
    return words.select("document_id", "page_number", "text", "left", base.alias("bottom"))


def line_clusters(s, d):
    """Words put into lines again."""
    return P.cluster_lines(_words(s, d)).select(
        "document_id", "page_number", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


#: Lines added to the first pages of every seventh document, so that each fact occurs.
EXTRA_LINES = [
    "ООО «Вектор плюс», г. Казань", "Confidential user manual, Paris 2019", "Паспорт. Для служебного пользования", "Регламент 1985 и 2031 года", "Отчет завода Прибор, г. уфа",
    "Тел. 12-34, Москва", "",
]
TODAY = "2025-12-31"


def _first_pages(s, d):
    """First pages with codes and extra lines planted, and properties of the file for some."""
    docs = documents(s, d).where(F.col("source_path").endswith(".pdf") & F.col("content").isNotNull())
    before = F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")
    lines = F.filter(F.transform(F.slice(before, 1, 30), X.trim), lambda x: (x != "") & ~x.rlike(P.MARKER))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"\b([A-Z]{2})-(\d{4})\b", "$1.$2.$2 A"))
    n = F.regexp_extract("document_id", r"(\d+)$", 1).cast("int")
    extra = F.filter(F.array(F.get(F.array(*map(F.lit, EXTRA_LINES)), n % 7)), lambda x: x != "")
    return docs.select(
        "document_id", "source_path", F.concat(extra, lines).alias("lines"), F.when(n % 3 == 0, F.col("metadata.title")).when(n % 3 == 1, "Document 1").alias("info_title"),
        F.when(n % 4 == 0, F.col("metadata.author")).when(n % 4 == 1, "Administrator").alias("info_author"), F.when(n % 2 == 0, F.col("metadata.last_modified")).alias("modified"),
    )


def pdf_metadata(s, d):
    """All facts that a loader takes from the first page, the path and the properties of a file."""
    return document_facts(_first_pages(s, d), TODAY)


# -- chunkers ------------------------------------------------------------------------


def _chunk_out(df):
    return df.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.sha2("text", 256).alias("hash"),
                     F.col("start_char_offset").cast("bigint").alias("start"), F.col("end_char_offset").cast("bigint").alias("end"))


def chunk_fixed(s, d):
    return _chunk_out(C.fixed_size(documents(s, d), "document_id", "content", 500, 100))


def chunk_sentence(s, d):
    return _chunk_out(C.sentence_groups(documents(s, d), "document_id", "content", 3))


def chunk_recursive(s, d):
    return _chunk_out(C.recursive(documents(s, d), "document_id", "content", 400))


def chunk_token_ws(s, d):
    rows = C.words(documents(s, d).where("content is not null"), "document_id", "content", 64)
    return rows.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.sha2("text", 256).alias("hash"))


def chunk_token_greedy(s, d):
    rows = chunks(s, d).select("chunk_id", "document_id", "chunk_index", "text", "start_char_offset", "end_char_offset")
    return C.token_budget(rows, 80)


def chunk_reindex(s, d):
    """Chunks under 500 characters and those without text go; what stays is numbered anew."""
    kept = chunks(s, d).where("length(text) >= 500").select("document_id", "chunk_index", F.col("chunk_id").alias("old_id"))
    out = C.reindexed(kept.withColumn("old", F.col("chunk_index")), ["chunk_index", "old_id"])
    return out.select("chunk_id", "document_id", "old_id", "chunk_index")


def semantic_islands(s, d):
    rows = vectors(s, d).select("document_id", F.col("chunk_index").alias("sentence_no"), F.coalesce("text", F.lit("")).alias("text"), "vector")
    out = C.semantic_islands(rows, 0.05)
    return out.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "sentences", F.sha2("text", 256).alias("hash"))


def adjacent_similarity(s, d):
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("chunk_index")
    rows = vectors(s, d).withColumn("before", F.lag("vector").over(order))
    return rows.where("before is not null").select("chunk_id", F.round(cosine(F.col("before"), F.col("vector")), 6).alias("similarity"))


def context_windows(s, d):
    both = chunks(s, d).join(documents(s, d).select("document_id", "content"), "document_id").where("content is not null")
    w = C.context_window(F.col("content"), F.col("start_char_offset"), F.col("end_char_offset"))
    return both.select("chunk_id", F.sha2(w, 256).alias("hash"), F.length(w).cast("bigint").alias("length"))


def code_chunks(s, d):
    """Code-like declarations made of document titles, as no table holds source files."""
    name = F.regexp_replace(F.initcap(F.col("metadata.title")), r"[^\p{L}\p{Nd}]", "")
    body = F.concat(F.lit("using System;\nnamespace Docs;\npublic class C"), name, F.lit("\n{\n  public int Run(int x)\n  {\n    return x;\n  }\n}\n"))
    rows = documents(s, d).where("metadata.title is not null").select("document_id", body.alias("code"), F.lit("a.cs").alias("path"))
    return C.code_declarations(rows, "document_id", "code", "path")


def atomic_table_chunks(s, d):
    return C.atomic_tables(documents(s, d), "document_id", "content", 5)


def prompt_prefixes(s, d):
    return chunks(s, d).where("text is not null").select(
        "chunk_id", F.sha2(X.prompt(F.col("text"), "nomic-embed", "document"), 256).alias("as_document"), F.sha2(X.prompt(F.col("text"), "mxbai-large", "query"), 256).alias("as_query")
    )


def sub_chunk_index(s, d):
    rows = I.index_rows(chunks(s, d).where("text is not null"), "sub-chunk")
    return rows.select("chunk_id", F.sha2("embed_text", 256).alias("hash"))


STRATEGIES = {".md": "sub-chunk", ".xlsx": "summary", ".pdf": "query"}


class _Echo:
    """A stand-in for a chat model: the last line of the prompt as it is, and again on a second line after a mark."""

    def complete(self, prompts):
        return ["\n".join((p.split("\n")[-1], "? " + p.split("\n")[-1])) for p in prompts]


def index_strategies(s, d):
    """Rows of the index of every chunk by the strategy of its document's extension."""
    routed = I.route_by_extension(documents(s, d), STRATEGIES).select("document_id", "strategy")
    rows = chunks(s, d).join(routed, "document_id").where("text is not null")
    out = None
    for name in ("chunk", *STRATEGIES.values()):
        part = I.index_rows(rows.where(F.col("strategy") == name), name, _Echo(), 2).select(F.lit(name).alias("strategy"), "chunk_id", F.sha2("embed_text", 256).alias("hash"))
        out = part if out is None else out.unionByName(part)
    return out


def word_documents(s, d):
    """Contents put together from the words of page_block, with page separators."""
    return _hashed(P.assemble_words(_words(s, d)), "document_id")


# -- index upkeep --------------------------------------------------------------------------


def bm25_stats(s, d):
    rows = I.corpus_stats(chunks(s, d).where("text is not null"))
    return rows.select("chunks", "tokens", F.round("average", 6).alias("average"))


def document_frequencies(s, d):
    p = I.postings(chunks(s, d).where("text is not null"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def upsert_latest(s, d):
    """The stored rows with the deliveries of embedded_chunk put over them: the latest of each chunk wins."""
    stored = table(s, d, "sqlite_vector_store").select("chunk_id", "document_id", "chunk_index", "model_id", F.lit("stored").alias("origin"))
    fresh = table(s, d, "embedded_chunk").select("chunk_id", "document_id", "chunk_index", "model_id", F.lit("embedded").alias("origin"), F.struct("embedded_at", "model_id").alias("at"))
    return I.upsert(stored, fresh, order="at")


def delete_ids(s, d):
    stored = table(s, d, "sqlite_vector_store").select("chunk_id", "collection_name", "document_id")
    return I.delete(stored, table(s, d, "embedded_chunk").select("chunk_id"))


def collection_counts(s, d):
    return table(s, d, "sqlite_vector_store").groupBy("collection_name", "model_id").agg(F.count("*").alias("chunks"))


def chunk_lookup(s, d):
    """Stored rows of the chunks that close their document."""
    last = chunks(s, d).groupBy("document_id").agg(F.max("chunk_index").alias("chunk_index"))
    ids = last.select(F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"))
    return table(s, d, "sqlite_vector_store").join(ids, "chunk_id", "left_semi").select("chunk_id", "document_id", "chunk_index")


def _rechunked(s, d):
    changed = table(s, d, "change_event").where("tenant_id is not null").select("document_id").distinct()
    rows = C.fixed_size(documents(s, d).join(changed, "document_id", "left_semi"), "document_id", "content", 900, 100)
    return rows.select(F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "chunk_index", F.length("text").alias("length"))


def reingest_diff(s, d):
    """Chunks of changed documents that are gone after chunking them anew."""
    return I.orphans(chunks(s, d).select("chunk_id", "document_id"), _rechunked(s, d))


def reingest_result(s, d):
    old = chunks(s, d).select("chunk_id", "document_id", "chunk_index", F.length("text").alias("length"))
    return typed(I.reingest(old, _rechunked(s, d)), length="bigint", chunk_index="bigint")


def search_keys(s, d):
    return chunks(s, d).select("chunk_id", X.base64url(F.col("chunk_id")).alias("key"))


def label_names(s, d):
    return documents(s, d).select("document_id", X.label(F.col("metadata.title")).alias("label"), X.slug(F.col("metadata.title")).alias("slug"))


def column_names(s, d):
    """Spreadsheet columns made of the codes in titles."""
    code = F.regexp_extract("metadata.title", r"([A-Z]{2})-\d", 1)
    rows = documents(s, d).select("document_id", code.alias("name")).where("name <> ''")
    return rows.select("document_id", "name", X.column_index(F.col("name")).cast("bigint").alias("place"))


def truncated(s, d):
    return chunks(s, d).where("text is not null").select("chunk_id", X.truncate(F.col("text"), 80).alias("short"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        filter_ops, filter_null_safe, filter_in_like, filter_custom, clean_text, clean_metadata, dehyphenate, page_split, header_footer_strip, page_boilerplate, reassemble,
        preprocess, markdown_tables, line_clusters, word_documents, pdf_metadata, chunk_fixed, chunk_sentence, chunk_recursive, chunk_token_ws, chunk_token_greedy, chunk_reindex,
        semantic_islands, adjacent_similarity, context_windows, code_chunks, atomic_table_chunks, prompt_prefixes, sub_chunk_index, index_strategies, bm25_stats,
        document_frequencies, upsert_latest, delete_ids, collection_counts, chunk_lookup, reingest_diff, reingest_result, search_keys, label_names, column_names, truncated,
    )
}

_W = r"\s\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}"
_LTRIM = "regexp_replace({0}, '^[" + _W + "]+', '')"
_TRIM = "regexp_replace({0}, '^[" + _W + "]+|[" + _W + "]+$', '', 'g')"
_U = r"\s\x0B\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"


def _clean(c: str, hyphens: bool = False) -> str:
    invisible = f"translate({c}, chr(160) || chr(8239) || chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(174) || chr(8482) || chr(169), '  ')"
    lines = rf"regexp_replace({invisible}, '\r\n?', chr(10), 'g')"
    lines = _dehyphenated(lines) if hyphens else lines
    leaders = rf"regexp_replace({lines}, '(?:\.[{_U}]*){{3,}}', ' ', 'g')"
    spaces = rf"regexp_replace({leaders}, '[\t\x0B\f\r \x{{85}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{205F}}\x{{3000}}]{{2,}}', ' ', 'g')"
    return _TRIM.format(rf"regexp_replace({spaces}, '\n{{3,}}', chr(10) || chr(10), 'g')")


_NEWLINES = r"regexp_replace({0}, '\r\n?', chr(10), 'g')"


def _dehyphenated(c: str) -> str:
    """Without look-around a match takes the letters at its end, so that pieces of two letters need another pass."""
    for _ in range(4):
        c = rf"regexp_replace({c}, '(\p{{L}}{{2}})[-‐‑]\n[{_U}\x{{A0}}\x{{202F}}]*(\p{{Ll}}{{2}})', '\1\2', 'g')"
    for _ in range(4):
        c = rf"regexp_replace({c}, '([A-Za-zА-Яа-я0-9])[-‐‑]\n[{_U}\x{{A0}}\x{{202F}}]*([A-Za-zА-Яа-я0-9])', '\1-\2', 'g')"
    return c


_LINES = rf"(SELECT document_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT document_id, source_path, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM {DOCUMENTS} WHERE content IS NOT NULL {{0}}))"


def _pages(lines: str = _LINES.format("")) -> str:
    return rf"""(SELECT document_id, page_index, {_TRIM.format('header')} AS header, {_TRIM.format('body')} AS body FROM (
      SELECT document_id, page_index, max(CASE WHEN m = 1 THEN line END) AS header, coalesce(string_agg(CASE WHEN m = 0 THEN line END, chr(10) ORDER BY line_no), '') AS body
      FROM (SELECT *, sum(m) OVER (PARTITION BY document_id ORDER BY line_no)::INTEGER AS page_index FROM (SELECT *, regexp_matches(line, '(?i)^## Page\s+\d+')::INTEGER AS m FROM {lines}))
      GROUP BY document_id, page_index))"""


_PDF = "AND source_path LIKE '%.pdf'"
_PLANTED = f"""(SELECT document_id, page_index, header, CASE WHEN page_index % 10 = 3 THEN 'Для записей.' WHEN page_index % 10 = 5 THEN '15' WHEN page_index % 10 = 7 THEN 'This page intentionally left blank!'
    WHEN page_index % 2 = 0 THEN body || chr(10) || 'Стр. ' || page_index || ' из 12' ELSE body END AS body FROM {_pages()})"""


def _stripped(pages: str) -> str:
    """Pages without running lines and page numbers: counts of first and last lines by table, then a look at each page's own."""
    fit = "length({0}) BETWEEN 3 AND 120 AND NOT starts_with({0}, '#') AND NOT starts_with({0}, '|')"
    often = lambda x: rf"""EXISTS (SELECT 1 FROM counts c WHERE c.document_id = e.document_id AND c.side = '{x}' AND c.shaped = false AND c.line = e.{x} AND c.times >= ceil(e.n * 0.5))
      OR EXISTS (SELECT 1 FROM counts c WHERE c.document_id = e.document_id AND c.side = '{x}' AND c.shaped AND c.line = regexp_replace(e.{x}, '\d+', '#', 'g') AND c.times >= ceil(e.n * 0.5))"""  # noqa: E731
    part = lambda x, shaped: f"""SELECT document_id, '{x}' AS side, {str(shaped).lower()} AS shaped, {f"regexp_replace({x}, '[0-9]+', '#', 'g')" if shaped else x} AS line, count(*) AS times
      FROM edges WHERE {fit.format(x)} GROUP BY ALL"""  # noqa: E731
    return rf"""(WITH edges AS MATERIALIZED (SELECT *, lower(ls[1]) AS top, lower(ls[-1]) AS bottom, count(*) OVER (PARTITION BY document_id) AS n FROM (
        SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') AS ls FROM {pages})),
      counts AS MATERIALIZED ({' UNION ALL '.join(part(x, sh) for x in ('top', 'bottom') for sh in (False, True))}),
      first AS MATERIALIZED (SELECT *, n >= 3 AND len(ls) > 0 AND ({often('top')}) AS drop_first FROM edges e),
      last AS MATERIALIZED (SELECT *, n >= 3 AND len(ls) > CASE WHEN drop_first THEN 1 ELSE 0 END AND (regexp_matches(bottom, '^(?:(?:стр\.?|page)\s*)?\d+(?:\s*(?:из|of|/)\s*\d+)?$') OR {often('bottom')}) AS drop_last FROM first e)
      SELECT document_id, page_index, header, drop_first, drop_last, CASE WHEN n >= 3 THEN array_to_string(list_slice(ls, CASE WHEN drop_first THEN 2 ELSE 1 END, len(ls) - CASE WHEN drop_last THEN 1 ELSE 0 END), chr(10))
        ELSE body END AS body FROM last)"""


_LETTERS = r"length(regexp_replace(body, '[^\p{L}]', '', 'g'))"
_KEEPS = rf"""({_TRIM.format('body')} <> '' AND (contains(body, '|') OR contains(body, '![') OR contains(body, '```') OR NOT ({_LETTERS} < 40 OR lower(regexp_replace({_TRIM.format('body')}, '[.!? ]+$', '')) IN
    ('для заметок', 'для записей', 'страница намеренно оставлена пустой', 'намеренно оставлено пустым', 'this page intentionally left blank', 'notes'))))"""


def _joined(pages: str, keep: str = "true") -> str:
    return f"""(SELECT document_id, {_TRIM.format('c')} AS c FROM (SELECT document_id, coalesce(string_agg(CASE WHEN coalesce(header, '') <> '' THEN header || chr(10) ELSE '' END || {_TRIM.format('body')} || chr(10), chr(10)
      ORDER BY page_index) FILTER ({keep}), '') AS c FROM {pages} GROUP BY document_id))"""


_CLEANED = f"(SELECT document_id, CASE WHEN {_TRIM.format('content')} = '' THEN content ELSE {_clean('content', True)} END AS content FROM {DOCUMENTS} WHERE content IS NOT NULL)"
_CLEAN_LINES = r"(SELECT document_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT document_id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM " + _CLEANED + "))"
_CLEAN_PAGES = f"(SELECT * EXCLUDE (pages) FROM (SELECT *, count(*) OVER (PARTITION BY document_id) AS pages FROM {_pages(_CLEAN_LINES)}) WHERE pages > 1)"

_SPANS = """SELECT document_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS t FROM ({0})"""


def _spans(parts: str) -> str:
    """Trimmed pieces with offsets from contiguous strings (document_id, parts)."""
    return rf"""SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY i) - 1)::BIGINT AS chunk_index, sha256(x) AS hash, s::BIGINT AS start, (s + length(x))::BIGINT AS "end"
      FROM (SELECT document_id, i, {_TRIM.format('t')} AS x, off + length(t) - length({_LTRIM.format('t')}) AS s
        FROM (SELECT document_id, i, t, coalesce(sum(length(t)) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ({_SPANS.format(parts)})))
      WHERE x <> ''"""


def _recursive(limit: int) -> str:
    parts = "[content]"
    for sep in C.SEPARATORS:
        lit = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep)
        parts = f"flatten(list_transform({parts}, lambda p: CASE WHEN length(p) <= {limit} THEN [p] ELSE string_split(replace(p, {lit}, {lit} || chr(1)), chr(1)) END))"
    hard = f"flatten(list_transform({parts}, lambda p: list_transform(range(0, greatest(1, ceil(length(p) / {limit}::DOUBLE))::BIGINT), lambda i: substring(p, i * {limit} + 1, {limit}))))"
    return f"SELECT document_id, {hard} AS parts FROM {DOCUMENTS} WHERE length(content) > 0"


def _sentences(size: int) -> str:
    s = r"string_split(regexp_replace(content, '([.!?])([ \t\r\n]+)([\p{Lu}0-9])', '\1\2' || chr(1) || '\3', 'g'), chr(1))"
    return f"""SELECT document_id, list_transform(range(0, ceil(len(s) / {size}::DOUBLE)::BIGINT), lambda i: array_to_string(s[i * {size} + 1 : i * {size} + {size}], '')) AS parts
      FROM (SELECT document_id, {s} AS s FROM {DOCUMENTS} WHERE length(content) > 0)"""


_WORDS = r"list_filter(regexp_split_to_array(content, '[ \t\r\n]+'), lambda x: x <> '')"
_FIXED = """SELECT document_id, i AS chunk_index, substring(content, i * ({0} - {1}) + 1, {0}) AS text, i * ({0} - {1}) AS start FROM (SELECT document_id, content,
    unnest(range(0, greatest(0, ceil((length(content) - {0}) / ({0} - {1})::DOUBLE))::BIGINT + 1)) AS i FROM {2} WHERE length(content) > 0 {3})"""
_REDONE = _FIXED.format(900, 100, DOCUMENTS, "AND document_id IN (SELECT document_id FROM change_event WHERE tenant_id IS NOT NULL)")
_COSINE = "round(list_cosine_similarity(before::DOUBLE[], vector::DOUBLE[]), 6)"
_M = "(SELECT chunk_id, metadata.silo AS silo, metadata.department AS department, metadata.document_type AS document_type, metadata.fiscal_year AS fiscal_year, metadata.title AS title, metadata.office AS office FROM " + CHUNKS + ")"

_FIRST_SENTENCE = _TRIM.format("regexp_replace(text, '(?s)([.!?])[" + _U + chr(92) + "x{A0}" + chr(92) + "x{202F}].*$', '" + chr(92) + "1')")
_CLUSTERS = r"""SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY baseline DESC) AS line_no, line FROM (
        SELECT document_id, page_number, round_even((9000.0 - line_no * 12 + (pos % 2) * 0.5) / 3.0, 0) * 3.0 AS baseline, string_agg(w, ' ' ORDER BY pos) AS line FROM (
        SELECT document_id, page_number, line_no, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM (
        SELECT document_id, page_number, generate_subscripts(l, 1) - 1 AS line_no, string_split(unnest(l), ' ') AS ws FROM (
        SELECT document_id, page_number, regexp_split_to_array(body, '\r?\n') AS l FROM (SELECT DISTINCT document_id, page_number, body FROM page_block))))
        WHERE w <> '' GROUP BY ALL)"""
# RE2 knows word borders of ASCII alone: what stands before and after is matched with the word
_BORDER = r"(?:^|[^\p{L}\p{M}\p{Nd}_])", r"(?:$|[^\p{L}\p{M}\p{Nd}_])"
_CODE = f"(?i){_BORDER[0]}{facts.CODE[2:-2]}{_BORDER[1]}"
_YEAR = f"{_BORDER[0]}{facts.YEAR[2:-2]}{_BORDER[1]}"


def _phrases(table: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in table.items()) + f" ELSE '{default}' END"


_FIRST_PAGES = rf"""(SELECT document_id, source_path, list_concat(list_filter([({EXTRA_LINES})[n % 7 + 1]], lambda x: x <> ''), list_transform(list_filter(list_transform(
      list_slice(string_split({_NEWLINES.format('content')}, chr(10)), 1, 30), lambda x: {_TRIM.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^## Page\s+\d+')),
      lambda x: regexp_replace(x, '\b([A-Z]{{2}})-(\d{{4}})\b', '\1.\2.\2 A', 'g'))) AS ls, CASE n % 3 WHEN 0 THEN metadata.title WHEN 1 THEN 'Document 1' END AS info_title,
      CASE n % 4 WHEN 0 THEN metadata.author WHEN 1 THEN 'Administrator' END AS info_author, CASE WHEN n % 2 = 0 THEN metadata.last_modified END AS modified, regexp_extract(source_path, '([^/]+)/[^/]*$', 1) AS folder,
      regexp_replace(regexp_replace(source_path, '^.*/', ''), '\.[^.]*$', '') AS file_name FROM (SELECT *, regexp_extract(document_id, '(\d+)$', 1)::INTEGER AS n FROM {DOCUMENTS}
      WHERE content IS NOT NULL AND suffix(source_path, '.pdf')))"""
_FACTS = rf"""(WITH a AS (SELECT *, {_TRIM.format("coalesce(list_filter(list_transform(ls, lambda x: regexp_extract(x, '" + _CODE + "', 1)), lambda x: x <> '')[1], regexp_extract(file_name, '" + _CODE + "', 1))")} AS code,
        {_TRIM.format("coalesce(info_title, '')")} AS info, {_TRIM.format("coalesce(info_author, '')")} AS person, list_filter(ls, lambda x: length(x) > 6 AND NOT regexp_matches(x, '(?i){facts.NO_TITLE_LINE}') AND NOT regexp_matches(x, '{_CODE}')) AS shown,
        list_filter(ls, lambda x: regexp_matches(x, '(?i){facts.ORGANISATION}'))[1] AS org FROM {_FIRST_PAGES}),
      b AS (SELECT *, array_to_string(shown[1:2], ' — ') AS both_lines, coalesce(CASE WHEN regexp_matches(org, '{facts.ORGANISATION_NAME}') THEN trim(regexp_extract(org, '{facts.ORGANISATION_NAME}', 0), ' «»"') ELSE {_TRIM.format('org')} END, '') AS company,
        list_filter(list_transform(list_reverse(ls), lambda x: TRY_CAST(regexp_extract(x, '{_YEAR}', 1) AS INTEGER)), lambda x: x BETWEEN 1990 AND 2025)[1] AS y FROM a),
      c AS (SELECT *, CASE WHEN info <> '' AND NOT regexp_matches(info, '(?i){facts.NO_TITLE}') AND NOT suffix(lower(info), '.pdf') THEN info WHEN len(shown) > 0 THEN CASE WHEN code <> '' AND NOT contains(lower(both_lines), lower(code))
        THEN code || ' — ' || both_lines ELSE both_lines END ELSE file_name END AS title FROM b),
      e AS (SELECT *, lower(title || ' ' || array_to_string(ls, ' ')) AS low FROM c)
    SELECT document_id, coalesce(nullif(trim(regexp_replace(CASE WHEN code <> '' THEN code ELSE file_name END, '[^\p{{L}}\p{{Nd}}.\-_]+', '-', 'g'), '-'), ''), 'doc-' || left(sha256(document_id), 8)) AS id,
      CASE WHEN folder IN ({", ".join(f"'{x}'" for x in facts.SILOS)}) THEN folder ELSE 'technical-docs' END AS silo, 'Engineering' AS department,
      coalesce(list_filter(list_transform(ls, lambda x: regexp_extract(x, '(?i){facts.CITY}', 0)), lambda x: x <> '')[1], 'Central') AS office, {_phrases(facts.LEVELS, 'Public')} AS confidentiality_level,
      {_phrases(facts.TYPES, 'Specification')} AS document_type, coalesce(y, least(year(modified), 2025), 2025)::INTEGER AS fiscal_year, CASE WHEN person <> '' AND NOT contains(lower(person), 'user') AND NOT contains(lower(person), 'admin')
        THEN CASE WHEN company <> '' AND NOT contains(lower(person), lower(company)) THEN person || ' (' || company || ')' ELSE person END WHEN company <> '' THEN company ELSE 'Unknown' END AS author,
      coalesce(modified, DATE '2025-12-31') AS last_modified, title FROM e)"""

SQL: dict[str, str] = {
    "filter_ops": f"""SELECT chunk_id, silo, fiscal_year FROM {_M} WHERE (coalesce(fiscal_year >= 2019, false) AND coalesce(fiscal_year < 2024, false) AND NOT coalesce(silo = 'legal-contracts', false))
        OR coalesce(contains(title, 'index'), false)""",
    "filter_null_safe": f"""SELECT chunk_id, department, document_type FROM {_M} WHERE (department IS DISTINCT FROM 'HR' AND document_type IS DISTINCT FROM 'Policy') OR (office IS NULL AND department IS NULL)""",
    "filter_in_like": f"""SELECT chunk_id, title FROM {_M} WHERE silo IN ('hr-policies', 'technical-docs') AND (starts_with(title, 'R') OR title LIKE '%e')""",
    "filter_custom": f"""SELECT chunk_id, title FROM {_M} WHERE left(lower(coalesce(title, '')), 1) IN ('a', 'e', 'i', 'o', 'u', '')""",
    "clean_text": f"SELECT document_id, sha256(c) AS hash, length(c)::BIGINT AS length FROM (SELECT document_id, {_clean('content')} AS c FROM {DOCUMENTS} WHERE content IS NOT NULL)",
    "clean_metadata": f"SELECT document_id, {_clean('metadata.title')} AS title, {_clean('metadata.author')} AS author FROM {DOCUMENTS}",
    "page_split": f"SELECT document_id, page_index, header, sha256(body) AS hash, length(body)::BIGINT AS length FROM {_pages()}",
    "header_footer_strip": f"SELECT document_id, page_index, drop_first, drop_last, sha256(body) AS hash, length(body)::BIGINT AS length FROM {_stripped(_PLANTED)}",
    "page_boilerplate": f"SELECT document_id, page_index, {_LETTERS}::BIGINT AS letters FROM {_PLANTED} WHERE {_KEEPS}",
    "reassemble": f"SELECT document_id, sha256(c) AS hash, length(c)::BIGINT AS length FROM {_joined(_pages())}",
    "dehyphenate": f"SELECT document_id, sha256(c) AS hash, length(c)::BIGINT AS length FROM (SELECT document_id, {_dehyphenated(_NEWLINES.format('content'))} AS c FROM {DOCUMENTS} WHERE content IS NOT NULL)",
    "preprocess": f"""SELECT document_id, sha256(c) AS hash, length(c)::BIGINT AS length FROM (SELECT document_id, coalesce(j.c, d.content) AS c
        FROM {_CLEANED} d LEFT JOIN {_joined(_stripped(_CLEAN_PAGES), _KEEPS)} j USING (document_id))""",
    "markdown_tables": f"""SELECT document_id, table_no::BIGINT AS table_no, min(line_no)::BIGINT AS first_line, count(*) AS lines, sha256(string_agg(l, chr(10) ORDER BY line_no)) AS hash FROM (
        SELECT *, sum(CASE WHEN b AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line_no) AS table_no FROM (
        SELECT *, coalesce(lag(b) OVER (PARTITION BY document_id ORDER BY line_no), false) AS before FROM (
        SELECT *, trim(line, ' ') AS l, starts_with(trim(line, ' '), '|') AND suffix(trim(line, ' '), '|') AS b FROM {_LINES.format('')}))) WHERE b GROUP BY document_id, table_no""",
    "line_clusters": _CLUSTERS,
    "word_documents": rf"""SELECT document_id, sha256(c) AS hash, length(c)::BIGINT AS length FROM (SELECT document_id, regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY page_number), '[{_U}\x{{A0}}\x{{202F}}]+$', '') AS c FROM (
        SELECT document_id, page_number, '## Page ' || page_number || chr(10) || chr(10) || string_agg(l, chr(10) ORDER BY line_no) || chr(10) AS t FROM (SELECT *, {_TRIM.format('line')} AS l FROM ({_CLUSTERS})) WHERE l <> '' GROUP BY document_id, page_number) GROUP BY document_id)""",
    "pdf_metadata": f"SELECT * FROM {_FACTS}",
    "chunk_fixed": f"""SELECT document_id, chunk_index::BIGINT AS chunk_index, sha256(text) AS hash, start::BIGINT AS start, (start + length(text))::BIGINT AS "end" FROM ({_FIXED.format(500, 100, DOCUMENTS, '')})""",
    "chunk_sentence": _spans(_sentences(3)),
    "chunk_recursive": _spans(_recursive(400)),
    "chunk_token_ws": f"""SELECT document_id, i::BIGINT AS chunk_index, sha256(array_to_string(w[i * 64 + 1 : i * 64 + 64], ' ')) AS hash FROM (
        SELECT document_id, w, unnest(range(0, (len(w) - 1) // 64 + 1)) AS i FROM (SELECT document_id, {_WORDS} AS w FROM {DOCUMENTS} WHERE content IS NOT NULL) WHERE len(w) > 0)""",
    "chunk_reindex": f"""SELECT document_id || '#' || n AS chunk_id, document_id, old_id, n::INTEGER AS chunk_index FROM (SELECT document_id, chunk_id AS old_id,
        row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1 AS n FROM {CHUNKS} WHERE length(text) >= 500)""",
    "semantic_islands": f"""SELECT document_id, chunk_index::BIGINT AS chunk_index, count(*) AS sentences, sha256(string_agg(text, ' ' ORDER BY chunk_no)) AS hash FROM (
        SELECT document_id, chunk_no, text, sum(b) OVER (PARTITION BY document_id ORDER BY chunk_no) - 1 AS chunk_index FROM (
        SELECT *, CASE WHEN before IS NULL OR {_COSINE} < 0.05 THEN 1 ELSE 0 END AS b FROM (SELECT document_id, chunk_index AS chunk_no, coalesce(text, '') AS text, vector,
        lag(vector) OVER (PARTITION BY document_id ORDER BY chunk_index) AS before FROM {VECTORS}))) GROUP BY ALL""",
    "adjacent_similarity": f"""SELECT chunk_id, {_COSINE} AS similarity FROM (SELECT chunk_id, vector, lag(vector) OVER (PARTITION BY document_id ORDER BY chunk_index) AS before FROM {VECTORS}) WHERE before IS NOT NULL""",
    "context_windows": f"""SELECT chunk_id, sha256(w) AS hash, length(w)::BIGINT AS length FROM (SELECT chunk_id, CASE WHEN length(content) <= 8000 THEN content WHEN greatest(0, a - 2750) <= 2500 THEN left(content, 8000)
        ELSE left(content, 2500) || chr(10) || '[...]' || chr(10) || substring(content, greatest(0, a - 2750) + 1, z + 2750 - greatest(0, a - 2750)) END AS w
        FROM (SELECT c.chunk_id, d.content, c.start_char_offset AS a, c.end_char_offset AS z FROM {CHUNKS} c JOIN {DOCUMENTS} d USING (document_id) WHERE d.content IS NOT NULL))""",
    "prompt_prefixes": f"""SELECT chunk_id, sha256('search_document: ' || text) AS as_document, sha256('Represent this sentence for searching relevant passages: ' || text) AS as_query
        FROM {CHUNKS} WHERE text IS NOT NULL""",
    "sub_chunk_index": rf"SELECT chunk_id, sha256(f) AS hash FROM (SELECT chunk_id, {_FIRST_SENTENCE} AS f FROM {CHUNKS} WHERE text IS NOT NULL) WHERE f <> ''",
    "index_strategies": rf"""WITH c AS (SELECT c.*, CASE lower(regexp_extract(source_path, '(\.[^./]+)$', 1)) WHEN '.md' THEN 'sub-chunk' WHEN '.xlsx' THEN 'summary' WHEN '.pdf' THEN 'query' ELSE 'chunk' END AS strategy,
          {_TRIM.format("string_split(text, chr(10))[-1]")} AS z, string_split(text, chr(10))[-1] AS raw FROM {CHUNKS} c JOIN {DOCUMENTS} d USING (document_id) WHERE text IS NOT NULL)
        SELECT strategy, chunk_id, sha256(x) AS hash FROM (SELECT strategy, chunk_id, text AS x FROM c WHERE strategy = 'chunk' UNION ALL SELECT strategy, chunk_id, {_FIRST_SENTENCE} FROM c WHERE strategy = 'sub-chunk'
          UNION ALL SELECT strategy, chunk_id, z FROM c WHERE strategy = 'query' UNION ALL SELECT strategy, chunk_id, {_TRIM.format("'? ' || raw")} FROM c WHERE strategy = 'query'
          UNION ALL SELECT strategy, chunk_id, {_TRIM.format("raw || chr(10) || '? ' || raw")} FROM c WHERE strategy = 'summary') WHERE strategy = 'chunk' OR x <> ''""",
    "bm25_stats": rf"""SELECT count(*) AS chunks, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS average FROM (SELECT len(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}_]+')) AS n FROM {CHUNKS} WHERE text IS NOT NULL)""",
    "document_frequencies": rf"""SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}_]+')) AS term
        FROM {CHUNKS} WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY term""",
    "upsert_latest": """SELECT chunk_id, document_id, chunk_index, model_id, 'stored' AS origin FROM sqlite_vector_store WHERE chunk_id NOT IN (SELECT chunk_id FROM embedded_chunk)
        UNION ALL SELECT * FROM (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, chunk_index, model_id, 'embedded' AS origin FROM embedded_chunk ORDER BY chunk_id, embedded_at DESC, model_id DESC)""",
    "delete_ids": "SELECT chunk_id, collection_name, document_id FROM sqlite_vector_store WHERE chunk_id NOT IN (SELECT chunk_id FROM embedded_chunk)",
    "collection_counts": "SELECT collection_name, model_id, count(*) AS chunks FROM sqlite_vector_store GROUP BY ALL",
    "chunk_lookup": f"""SELECT chunk_id, document_id, chunk_index FROM sqlite_vector_store WHERE chunk_id IN (SELECT document_id || '#' || max(chunk_index) FROM {CHUNKS} GROUP BY document_id)""",
    "reingest_diff": f"""SELECT chunk_id, document_id FROM {CHUNKS} WHERE document_id IN (SELECT document_id FROM ({_REDONE})) AND chunk_id NOT IN (SELECT document_id || '#' || chunk_index FROM ({_REDONE}))""",
    "reingest_result": f"""SELECT chunk_id, document_id, chunk_index::BIGINT AS chunk_index, length(text)::BIGINT AS length FROM {CHUNKS} WHERE document_id NOT IN (SELECT document_id FROM ({_REDONE}))
        UNION ALL SELECT document_id || '#' || chunk_index, document_id, chunk_index::BIGINT, length(text)::BIGINT FROM ({_REDONE})""",
    "search_keys": f"SELECT chunk_id, rtrim(translate(to_base64(encode(chunk_id)), '+/', '-_'), '=') AS key FROM {CHUNKS}",
    "label_names": rf"""SELECT document_id, coalesce(nullif(regexp_replace(t, '[^\p{{L}}\p{{Nd}}_]', '', 'g'), ''), 'Unknown') AS label,
        coalesce(nullif(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{Nd}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'node') AS slug FROM (SELECT document_id, metadata.title AS t FROM {DOCUMENTS})""",
    "column_names": rf"""SELECT document_id, name, ((ascii(name[1]) - 64) * 26 + ascii(name[2]) - 64 - 1)::BIGINT AS place FROM (SELECT document_id, regexp_extract(metadata.title, '([A-Z]{{2}})-\d', 1) AS name FROM {DOCUMENTS}) WHERE name <> ''""",
    "truncated": rf"""SELECT chunk_id, CASE WHEN length(f) <= 80 THEN f ELSE left(f, 80) || '...' END AS short FROM (SELECT chunk_id, trim(regexp_replace(text, '[\r\n]+', ' ', 'g'), ' ') AS f FROM {CHUNKS} WHERE text IS NOT NULL)""",
}
