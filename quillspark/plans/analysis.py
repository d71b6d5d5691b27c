"""Queries of quality, evaluation, element joins, graphs, trees, state and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import attach as A
from quillspark.operators import evaluate as E
from quillspark.operators import graph as G
from quillspark.operators import index as I
from quillspark.operators import pages as P
from quillspark.operators import retrieve as R
from quillspark.operators import state as S
from quillspark.operators import structure as V
from quillspark.plans.base import CHUNKS, DOCUMENTS, QUESTIONS, Query, bm25_sql, chunks, documents, typed
from quillspark.plans.ingest import _LINES, _TRIM
from quillspark.runtime import new_folder, table
from quillspark.streaming import feed

TEXTS = [(q, t) for q, t, _ in QUESTIONS]
#: Expected facts and keywords of the questions.
FACTS = {"q1": ["vendor annex", "finance team"], "q2": ["power feed", "turbine housing", "quarterly"], "q3": ["контроллер", "ночной смены"], "q4": ["registre", "filiale"]}
KEYWORDS = {"q1": ["annual", "annex", "team", "register"], "q2": ["feed"], "q3": ["журнал", "контроллер", "смены"], "q4": ["annuel", "registre", "filiale", "badge"]}
NOW = "2025-06-01 00:00:00"


def _silo(s, d):
    return chunks(s, d).withColumn("silo", F.col("metadata.silo"))


# -- quality -----------------------------------------------------------------------


def chunk_quality(s, d):
    return typed(E.size_summary(_silo(s, d).where("text is not null"), "silo", "text"), chunks="bigint", mean="double", deviation="double")


def token_quality(s, d):
    rows = _silo(s, d).where("text is not null").withColumn("n", F.size(X.tokens(F.col("text"))))
    return E.over_budget(rows, "silo", F.col("n"), (64, 96, 128))


def size_histogram(s, d):
    return E.histogram(_silo(s, d), "silo", "text")


def dup_chunks(s, d):
    """Over the rows as delivered, repeated ones included."""
    rows = table(s, d, "document_chunk").withColumn("silo", F.col("metadata.silo"))
    return E.duplicates(rows, "silo", "text")


def coverage_intervals(s, d):
    docs = documents(s, d).where(F.length("content") > 0).select("document_id", F.length("content").alias("length"))
    return E.coverage(chunks(s, d), docs)


def line_coverage(s, d):
    return E.line_coverage(chunks(s, d), documents(s, d).where("content is not null"))


def table_integrity(s, d):
    rows = documents(s, d).withColumn("kind", F.regexp_extract("source_path", r"\.([^.]+)$", 1))
    return E.table_integrity(rows, "kind", "content")


def boundary_defects(s, d):
    return E.boundary_defects(_silo(s, d), "silo", "text")


def metadata_faults(s, d):
    return E.metadata_faults(chunks(s, d))


# -- evaluation ----------------------------------------------------------------------


def _judged(s, d):
    top = R.bm25(chunks(s, d).where("text is not null"), TEXTS, 10)
    rows = R.payload(top, chunks(s, d), ["text"])
    maps = [F.create_map(*(x for q in m for x in (F.lit(q), F.array(*map(F.lit, m[q]))))) for m in (FACTS, KEYWORDS)]
    return rows.withColumn("relevant", E.is_relevant(F.col("text"), maps[0][F.col("query_id")], maps[1][F.col("query_id")]))


def retrieval_metrics(s, d):
    return E.retrieval_metrics(_judged(s, d))


def relevance_judgements(s, d):
    return _judged(s, d).select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "relevant")


def answer_grounding(s, d):
    """Each chunk as an answer from the chunk before it in its document; some of them blank or failed."""
    n = F.col("chunk_index")
    text = F.when(n % 5 == 3, " ").when(n % 5 == 4, F.concat(F.lit("[Ошибка] "), "text")).otherwise(F.col("text"))
    a = chunks(s, d).where("text is not null").select("chunk_id", "document_id", "chunk_index", text.alias("text"))
    before = a.select("document_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("text").alias("context"))
    both = a.join(before, ["document_id", "chunk_index"])
    facts = F.array(F.lit("quarterly"), F.lit("vault"), F.lit("bar"))
    return both.select("chunk_id", E.grounded_share(F.col("text"), F.col("context")).alias("grounded"), E.fact_share(F.col("text"), facts).alias("correct"))


def extractive_answers(s, d):
    facts = F.array(F.lit("power feed"), F.lit("отчёт"), F.lit("rapport"))
    rows = chunks(s, d).where("text is not null").select("chunk_id", E.extractive_answer(F.col("text"), facts).alias("answer"))
    return rows.select("chunk_id", F.sha2("answer", 256).alias("hash"))


def cost_model(s, d):
    n = F.size(X.tokens(F.col("text")))
    rows = _silo(s, d).where("text is not null").select("silo", n.alias("prompt"), F.expr("100").alias("completion"))
    each = rows.withColumn("cost", E.cost(F.col("prompt"), F.col("prompt"), F.col("completion")))
    return each.groupBy("silo").agg(F.sum("prompt").alias("tokens"), F.sum("cost").cast("decimal(28,6)").cast("string").alias("cost"))


def composite_score(s, d):
    """Share of chunks without boundary defects, joined to retrieval and answer metrics that two silos lack."""
    q = boundary_defects(s, d).select("silo", (1 - F.col("starts_lower") / F.col("chunks")).alias("chunk"))
    known = s.createDataFrame([("hr-policies", 0.7, 0.6), ("technical-docs", 0.9, None), ("legal-contracts", None, 0.9)], "silo string, ndcg double, correct double")
    score = E.composite(F.col("chunk"), F.col("ndcg"), F.col("correct"))
    return q.join(known, "silo", "left").select("silo", score.alias("score"), E.composite_label(score).alias("label"))


# -- joins of elements with chunks -----------------------------------------------------


def _offsets(s, d):
    """Lines with the offset of their first character."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = P.split_lines(documents(s, d))
    return rows.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(order), F.lit(0)).cast("int"))


def _headings(s, d):
    return _offsets(s, d).where(F.col("line").rlike(V.HEADING)).select("document_id", "line_no", "at", X.trim(F.regexp_extract("line", V.HEADING, 2)).alias("title"))


def _page_spans(s, d):
    from pyspark.sql import Window

    marks = _offsets(s, d).where(F.col("line").rlike(P.MARKER)).select("document_id", F.regexp_extract("line", r"(\d+)", 1).cast("int").alias("page_number"), F.col("at").alias("page_start"))
    end = F.coalesce(F.lead("page_start").over(Window.partitionBy("document_id").orderBy("page_start")), F.lit(2147483647))
    return marks.withColumn("page_end", end)


def page_overlap(s, d):
    return A.chunk_pages(chunks(s, d), _page_spans(s, d))


def section_asof(s, d):
    return A.chunk_sections(chunks(s, d), _headings(s, d))


def _elements(s, d):
    """Headings as elements of five kinds by their line: with an offset, a content, a section, a page of their own, or nothing that fits."""
    n = F.col("line_no") % 5
    lines = A.raw_lines(documents(s, d)).where(F.col("line").rlike(V.HEADING)).withColumn("title", X.trim(F.regexp_extract("line", V.HEADING, 2)))
    pages = A.page_spans(documents(s, d))
    within = (F.col("at") >= F.col("page_start")) & (F.col("at") < F.col("page_end"))
    numbered = lines.join(pages, "document_id").where(within).select("document_id", "line_no", "at", "title", "page_number")
    return numbered.select(
        "document_id", F.concat_ws("@", "document_id", "line_no").alias("element_id"), F.when(n == 3, F.col("page_number")).otherwise(9999).alias("page_number"),
        F.when(n == 2, F.upper("title")).alias("section_heading"), F.when(n == 0, F.col("at")).when((n == 4) & (F.col("line_no") % 2 == 0), F.col("at") + 1000000).otherwise(0).alias("start_char_offset"),
        F.when(n == 1, F.col("title")).alias("content"), "title", "line_no", "at",
    )


def element_attach(s, d):
    """To the chunks of their documents, by all five levels."""
    return A.attach_elements(_elements(s, d), A.chunk_places(chunks(s, d), documents(s, d)))


def chunk_places(s, d):
    rows = A.chunk_places(chunks(s, d), documents(s, d))
    return rows.select("chunk_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "section")


def multimodal_chunks(s, d):
    """Headings as figures and tables, in the texts of the chunks that they belong to."""
    table_of = F.concat(F.lit("| "), "title", F.lit(" |\n| --- |"))
    e = _elements(s, d).withColumn("kind", F.when(F.col("line_no") % 2 == 0, "Figure").otherwise("Table")).withColumn("element_no", F.col("line_no"))
    e = e.withColumn("content", F.when(F.col("kind") == "Table", table_of).otherwise(F.concat(F.lit("Picture of "), "title")))
    rows = A.augmented(chunks(s, d), e, documents(s, d))
    return rows.select("chunk_id", F.sha2("text", 256).alias("hash"), F.col("figures").cast("bigint").alias("figures"), F.col("tables").cast("bigint").alias("tables"))


def element_nearest(s, d):
    return A.nearest_chunk(_elements(s, d).withColumn("start_char_offset", F.col("at")), chunks(s, d))


def element_texts(s, d):
    """Chunks with the heading of their section appended as a table's caption, unless it is there already."""
    rows = chunks(s, d).where("text is not null").join(section_asof(s, d).where("section is not null"), ["document_id", "chunk_id"])
    added = A.element_addition(F.col("text"), F.lit("Table"), F.concat(F.lit("t-"), "chunk_id"), F.col("section"))
    return rows.select("chunk_id", F.sha2(F.concat("text", added), 256).alias("hash"))


def numbered_headings(s, d):
    """Lines that a loader turns into headings by their numbers: of the contents without their own marks."""
    rows = P.split_lines(documents(s, d)).withColumn("line", F.regexp_replace("line", r"^#+\s+", ""))
    return rows.withColumn("made", X.numbered_heading(F.col("line"))).where("made <> line").select("document_id", "line_no", "made")


def graph_search(s, d):
    """Nations and regions by a word, with what is one step away."""
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"))
    r = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("Region").alias("type"), F.col("r_name").alias("name"))
    return G.search(n.unionByName(r), _edges(s, d).where("to_id like 'r%'"), ["an", "asia"], 1)


def graph_search_all(s, d):
    """Entities of the whole graph by a word, customers and suppliers included, with what is within two steps."""
    return G.search(_entities(s, d), _edges(s, d), ["an", "asia"], 2)


def image_dedup(s, d):
    """Pages as stand-ins for images: a content that comes again in a document counts once."""
    rows = table(s, d, "page_block").select("document_id", "page_number", F.concat_ws("-", "document_id", "page_number").alias("image_id"), F.encode("body", "UTF-8").alias("data"))
    rows = rows.withColumns({"width": F.lit(100), "height": F.lit(100)})
    return I.first_images(rows, least_bytes=600).select("document_id", "page_number", "image_id")


# -- graph ----------------------------------------------------------------------------------


def entity_dedup(s, d):
    rows = documents(s, d).select(F.col("document_id").alias("id"), F.col("metadata.document_type").alias("type"), F.col("metadata.author").alias("name"))
    return G.dedup_entities(rows.where("name is not null"), "id")


def _edges(s, d):
    """Customers and suppliers to their nations, nations to their regions."""
    def pair(df, a, b):
        return df.select(F.concat(F.lit(a[0]), F.col(a[1])).alias("from_id"), F.concat(F.lit(b[0]), F.col(b[1])).alias("to_id"))

    c = pair(table(s, d, "customer"), ("C", "c_custkey"), ("n", "c_nationkey"))
    u = pair(table(s, d, "supplier"), ("S", "s_suppkey"), ("N", "s_nationkey"))
    return c.unionByName(u).unionByName(pair(table(s, d, "nation"), ("n", "n_nationkey"), ("r", "n_regionkey")))


def _entities(s, d):
    """All vertices of the graph of _edges: customers, suppliers, nations and regions."""
    def kind(name, letter, key, label):
        return table(s, d, name).select(F.concat(F.lit(letter), key).alias("id"), F.lit(name.capitalize()).alias("type"), F.col(label).alias("name"))

    c, u = kind("customer", "c", "c_custkey", "c_name"), kind("supplier", "s", "s_suppkey", "s_name")
    return c.unionByName(u).unionByName(kind("nation", "n", "n_nationkey", "n_name")).unionByName(kind("region", "r", "r_regionkey", "r_name"))


def connected_components(s, d):
    return G.connected_components(_edges(s, d))


def khop_traverse(s, d):
    return typed(G.within_hops(_edges(s, d), table(s, d, "region").where("r_name like 'A%'").select(F.concat(F.lit("R"), "r_regionkey").alias("id")), 2), hop="int")


def community_texts(s, d):
    names = table(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"))
    return G.community_texts(G.connected_components(_edges(s, d)), names)


def community_texts_all(s, d):
    """The communities with all their members, in blocks of 500."""
    return G.community_blocks(G.connected_components(_edges(s, d)), _entities(s, d))


def entity_texts(s, d):
    props = F.map_from_arrays(F.array(F.lit("silo"), F.lit("office")), F.array("metadata.silo", "metadata.office"))
    rows = documents(s, d).where("metadata.silo is not null and metadata.office is not null")
    return rows.select("document_id", G.entity_text(F.col("metadata.document_type"), F.col("metadata.title"), props).alias("text"))


# -- trees ---------------------------------------------------------------------------------------


def _tree(s, d):
    return V.heading_tree(documents(s, d))


def heading_tree(s, d):
    return V.node_ids(_tree(s, d)).select("document_id", "node_no", "level", "title", "path", "parent_no", "node_id", F.sha2("body", 256).alias("hash"))


def descendants(s, d):
    return V.descendants(_tree(s, d))


def ancestors(s, d):
    return V.ancestors(_tree(s, d))


def siblings(s, d):
    rows = V.siblings(_tree(s, d))
    return rows.select("document_id", "node_no", F.array_join(F.col("siblings").cast("array<string>"), ",").alias("siblings"))


def cross_refs(s, d):
    """Numbered headings and sections named in the text, both written as articles."""
    titled = F.regexp_replace("content", r"(?m)^(#+) (\d+)\. ", "$1 Article $2 ")
    named = F.regexp_replace(titled, r"(?:Sec\.|art\.|ст\.|п\.) (\d+)", "Article $1")
    return V.cross_references(V.heading_tree(documents(s, d).withColumn("content", named)))


def formal_references(s, d):
    rows = documents(s, d).where("content is not null")
    made = F.regexp_replace("content", r"(?:Sec\.|art\.|п\.) (\d+(?:\.\d+)?)", "Article $1 and § $1")
    return rows.select("document_id", F.array_join(F.array_sort(X.references(made)), ",").alias("refs")).where("refs <> ''")


# -- state and streams -------------------------------------------------------------------------------


def version_guard(s, d):
    return S.version_guard(table(s, d, "change_event")).select("seq", "document_id", "version")


def version_guard_tenant(s, d):
    """Of the tenant that sorts first."""
    events = table(s, d, "change_event")
    first = events.select(F.min("tenant_id").alias("t")).first()["t"]
    return S.version_guard(events, first).select("seq", "document_id", "version")


def latest_versions(s, d):
    return S.latest_versions(table(s, d, "change_event"))


def stream_version_guard(s, d):
    """The same guard over a stream of the table's files, with its state in the shared folder."""
    return feed.run_version_guard(feed.stream_table(s, d, "change_event"), new_folder(s, "feed")).select("seq", "document_id", "version")


def conversation_ttl(s, d):
    rows = table(s, d, "change_event").select(
        F.col("document_id").alias("conversation_id"), "version", F.struct("arrived_at", "seq").alias("at"), (F.col("arrived_at") + F.expr("interval 30 days")).alias("expires_at")
    )
    return S.live_states(rows, "conversation_id", "at", NOW).select("conversation_id", "version", "expires_at")


def summary_cache_key(s, d):
    rows = documents(s, d).where("metadata.author is not null").select(F.col("metadata.author").alias("author"), "document_id")
    return S.summary_keys(rows, "author", "document_id")


def summary_cache_evict(s, d):
    rows = documents(s, d).where("metadata.author is not null").select(F.col("metadata.author").alias("author"), "document_id")
    cache = rows.groupBy("author").agg(X.cache_key(F.collect_list("document_id")).alias("key"), F.collect_set("document_id").alias("members"))
    changed = table(s, d, "change_event").where("tenant_id is null").select(F.col("document_id").alias("id"))
    return S.evict(cache, changed).select("author", "key")


def events_tumbling(s, d):
    rows = feed.windowed_counts(table(s, d, "events"), "1 day")
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "total")


def events_sessions(s, d):
    rows = feed.sessions(table(s, d, "events"), "12 hours")
    return rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


# -- archives ------------------------------------------------------------------------------------------


def docx_scan(s, d):
    """Every document written as a docx archive and read again by the distributed reader."""
    from quillspark.runtime import ship
    from quillspark.sources import loaders, office

    ship(s)

    @F.udf("binary", useArrow=True)
    def write(content: str) -> bytes:
        return office.write_docx([p for p in content.split("\n\n") if p.strip()])

    rows = documents(s, d).where(F.length(X.trim(F.col("content"))) > 0)
    files = rows.select(F.concat(F.lit("/a/"), "document_id", F.lit(".docx")).alias("path"), write("content").alias("content"))
    out = loaders.parse_binary(files).select("source_path", "error", F.length(F.regexp_replace("content", r"(?U)[\s#]+", "")).cast("bigint").alias("signs"))
    return out


def xlsx_scan(s, d):
    """Tables of the .xlsx documents written as workbooks and read again."""
    from quillspark.runtime import ship
    from quillspark.sources import loaders, office

    ship(s)

    @F.udf("binary", useArrow=True)
    def write(content: str) -> bytes:
        rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in content.split("\n") if x.strip().startswith("|") and "---" not in x]
        return office.write_xlsx({"Data": rows})

    rows = documents(s, d).where(F.col("source_path").endswith(".xlsx") & F.col("content").contains("|"))
    files = rows.select(F.concat(F.lit("/a/"), "document_id", F.lit(".xlsx")).alias("path"), write("content").alias("content"))
    return loaders.parse_binary(files).select("source_path", "error", F.size(F.split("content", "\n")).cast("bigint").alias("lines"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        chunk_quality, token_quality, size_histogram, dup_chunks, coverage_intervals, line_coverage, table_integrity, boundary_defects, metadata_faults,
        retrieval_metrics, relevance_judgements, answer_grounding, extractive_answers, cost_model, composite_score, page_overlap, section_asof, element_attach, chunk_places, multimodal_chunks,
        element_nearest, element_texts, numbered_headings, graph_search, graph_search_all, image_dedup, entity_dedup, connected_components, khop_traverse, community_texts, community_texts_all, entity_texts, heading_tree, descendants, ancestors, siblings,
        cross_refs, formal_references, version_guard, version_guard_tenant, latest_versions, stream_version_guard, conversation_ttl, summary_cache_key,
        summary_cache_evict, events_tumbling, events_sessions, docx_scan, xlsx_scan,
    )
}

_SILO = f"(SELECT *, metadata.silo AS silo FROM {CHUNKS})"
_OFF = f"(SELECT document_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS off FROM {_LINES.format('')})"
_HEAD = rf"(SELECT document_id, line_no, off, {_TRIM.format(chr(114) + 'egexp_extract(line, ' + chr(39) + '^(#{1,6})' + chr(92) + 's+(.*)$' + chr(39) + ', 2)')} AS title FROM {_OFF} WHERE regexp_matches(line, '^(#{{1,6}})\s+(.*)$'))"
_ALL = f"(SELECT chunk_id, text FROM {CHUNKS} WHERE text IS NOT NULL)"
_ANSWERED = f"""(SELECT chunk_id, document_id, chunk_index, CASE WHEN chunk_index % 5 = 3 THEN ' ' WHEN chunk_index % 5 = 4 THEN '[Ошибка] ' || text ELSE text END AS text FROM {CHUNKS} WHERE text IS NOT NULL)"""
_SECTIONS = f"(SELECT c.document_id, c.chunk_id, h.title AS section FROM {CHUNKS} c ASOF LEFT JOIN {_HEAD} h ON c.document_id = h.document_id AND c.start_char_offset >= h.off)"
_RAW = f"""(SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS off FROM (
    SELECT document_id, length(content) AS size, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT document_id, content, string_split(content, chr(10)) AS l FROM {DOCUMENTS} WHERE content IS NOT NULL)))"""
_PAGE = r"(?i)^\s*(?:##\s*Page\s+|\[Page\s+|---\s*Page\s+)(\d+)"
_PAGE_SPANS = f"""(WITH m AS MATERIALIZED (SELECT document_id, n::INTEGER AS page_number, a, coalesce(lead(a) OVER (PARTITION BY document_id ORDER BY line_no), size) AS z FROM (SELECT *, regexp_extract(line, '{_PAGE}', 1) AS n,
      coalesce(last_value(CASE WHEN {_TRIM.format('line')} <> '' THEN off + length(line) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {_RAW}) WHERE n <> '')
    SELECT * FROM m UNION ALL SELECT document_id, 1, 0, length(content) FROM {DOCUMENTS} WHERE content IS NOT NULL AND document_id NOT IN (SELECT document_id FROM m))"""
_PLACES = rf"""(SELECT c.*, coalesce(p.pages, [coalesce(TRY_CAST(regexp_extract(c.text, '(?:##\s*Page\s+|\[Page\s+)(\d+)', 1) AS INTEGER), 1)]) AS pages,
    coalesce(nullif({_TRIM.format("regexp_extract(coalesce(c.text, ''), '(?m)^#{1,3}" + chr(92) + "s+(.+)$', 1)")}, ''),
      CASE WHEN c.start_char_offset > 0 AND c.start_char_offset <= d.size THEN {_TRIM.format("regexp_extract(substring(h.line, 1, c.start_char_offset - h.off), '^#{1,3}" + chr(92) + "s+(.+)$', 1)")} END) AS section
    FROM {CHUNKS} c LEFT JOIN (SELECT document_id, length(content) AS size FROM {DOCUMENTS} WHERE content IS NOT NULL) d USING (document_id)
    LEFT JOIN (SELECT chunk_id, list_sort(list(DISTINCT page_number)) AS pages FROM {CHUNKS} c JOIN {_PAGE_SPANS} s ON s.document_id = c.document_id AND c.start_char_offset < s.z AND c.end_char_offset > s.a
      WHERE c.end_char_offset > c.start_char_offset GROUP BY chunk_id) p ON p.chunk_id = c.chunk_id
    ASOF LEFT JOIN (SELECT document_id, off, line, off + length(regexp_extract(line, '^#{{1,3}}\s+.', 0)) AS place FROM {_RAW} WHERE regexp_matches(line, '^#{{1,3}}\s+(.+)$')) h ON h.document_id = c.document_id AND c.start_char_offset >= h.place)"""
_ELEMENTS = rf"""(SELECT l.document_id, l.document_id || '@' || line_no AS element_id, CASE WHEN line_no % 5 = 3 THEN page_number ELSE 9999 END AS page_number, CASE WHEN line_no % 5 = 2 THEN upper(title) END AS section_heading,
    CASE WHEN line_no % 5 = 0 THEN off WHEN line_no % 5 = 4 AND line_no % 2 = 0 THEN off + 1000000 ELSE 0 END AS start_char_offset, CASE WHEN line_no % 5 = 1 THEN title END AS content, title, line_no, off
    FROM (SELECT *, {_TRIM.format("regexp_extract(line, '^(#{1,6})" + chr(92) + "s+(.*)$', 2)")} AS title FROM {_RAW} WHERE regexp_matches(line, '^(#{{1,6}})\s+(.*)$')) l JOIN {_PAGE_SPANS} p ON p.document_id = l.document_id AND off >= p.a AND off < p.z)"""
_ATTACHED = f"""(SELECT document_id, element_id, chunk_id, level FROM (SELECT *, row_number() OVER (PARTITION BY document_id, element_id ORDER BY level, CASE WHEN level >= 4 AND start_char_offset > 0 THEN dist ELSE 0 END, chunk_index) AS r FROM (
    SELECT e.document_id, e.element_id, e.start_char_offset, c.chunk_id, c.chunk_index, abs(c.start_char_offset - e.start_char_offset) AS dist,
      (CASE WHEN e.start_char_offset > 0 AND e.start_char_offset BETWEEN c.start_char_offset AND c.end_char_offset THEN 1
        WHEN contains(lower(coalesce(c.text, '')), lower(e.element_id)) OR coalesce(e.content, '') <> '' AND contains(lower(coalesce(c.text, '')), lower(e.content)) THEN 2
        WHEN coalesce(e.section_heading, '') <> '' AND (coalesce(lower(c.section) = lower(e.section_heading), false) OR contains(lower(coalesce(c.text, '')), lower(e.section_heading))) THEN 3
        WHEN list_contains(c.pages, e.page_number) THEN 4 ELSE 5 END)::INTEGER AS level
    FROM <elements> e JOIN {_PLACES} c ON c.document_id = e.document_id)) WHERE r = 1)"""
_TOK = r"len(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+'))"


def _list(m: dict) -> str:
    return "CASE query_id " + " ".join(f"WHEN '{q}' THEN [" + ", ".join(f"'{x}'" for x in v) + "]" for q, v in m.items()) + " END"


_JUDGED = f"""(SELECT query_id, rank, chunk_id, (len(hf) >= least(2, len(facts))) OR (len(hk) >= least(3, len(keys))) AS relevant FROM (
    SELECT *, list_filter(facts, lambda f: contains(lower(text), lower(f))) AS hf, list_filter(keys, lambda f: contains(lower(text), lower(f))) AS hk FROM (
    SELECT r.*, c.text, {_list(FACTS)} AS facts, {_list(KEYWORDS)} AS keys FROM {bm25_sql(10, _ALL)} r JOIN {_ALL} c USING (chunk_id))))"""
_EDGES = """(SELECT lower(a) AS a, lower(b) AS b FROM (SELECT 'C' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation))"""
_ENTITIES = """(SELECT 'c' || c_custkey AS id, 'Customer' AS type, c_name AS name FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region)"""
_MEMBERS = """(SELECT n_regionkey AS r, 'c' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION SELECT n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT n_regionkey, 'r' || n_regionkey FROM nation)"""
_NODES = rf"""nodes AS MATERIALIZED (SELECT document_id, node_no, max(level) AS level, max(title) AS title, {_TRIM.format("coalesce(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY line_no), '')")} AS body FROM (
    SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY line_no)::INTEGER AS node_no FROM (
    SELECT document_id, line_no, line, CASE WHEN regexp_matches(line, '^(#{{1,6}})\s+(.*)$') THEN length(regexp_extract(line, '^(#{{1,6}})\s+(.*)$', 1))::INTEGER END AS level,
      CASE WHEN regexp_matches(line, '^(#{{1,6}})\s+(.*)$') THEN {_TRIM.format(chr(114) + 'egexp_extract(line, ' + chr(39) + '^(#{1,6})' + chr(92) + 's+(.*)$' + chr(39) + ', 2)')} END AS title FROM {_LINES.format('')}))
    WHERE node_no > 0 GROUP BY document_id, node_no),
  linked AS MATERIALIZED (SELECT a.*, (SELECT max(b.node_no) FROM nodes b WHERE b.document_id = a.document_id AND b.node_no < a.node_no AND b.level < a.level) AS parent_no FROM nodes a),
  up AS (SELECT document_id, node_no, parent_no AS ancestor_no, 1 AS distance FROM linked WHERE parent_no IS NOT NULL
    UNION ALL SELECT u.document_id, u.node_no, l.parent_no, u.distance + 1 FROM up u JOIN linked l ON l.document_id = u.document_id AND l.node_no = u.ancestor_no WHERE l.parent_no IS NOT NULL),
  paths AS (SELECT document_id, node_no, title AS path FROM linked WHERE parent_no IS NULL
    UNION ALL SELECT l.document_id, l.node_no, p.path || ' > ' || l.title FROM linked l JOIN paths p ON l.document_id = p.document_id AND l.parent_no = p.node_no)"""
_SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(path), '[^\p{L}\p{Nd}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'node')"
_AUTHORS = f"(SELECT DISTINCT metadata.author AS author, document_id FROM {DOCUMENTS} WHERE metadata.author IS NOT NULL)"
_GUARD = """SELECT seq, document_id, version FROM (SELECT *, max(version) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
    FROM change_event {0}) WHERE last IS NULL OR version > last"""

SQL: dict[str, str] = {
    "chunk_quality": f"""SELECT silo, count(*) AS chunks, min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(avg(n), 6) AS mean, list_sort(list(n))[count(*) // 2 + 1]::BIGINT AS median,
        round(stddev_pop(n), 6) AS deviation FROM (SELECT silo, length(text) AS n FROM {_SILO} WHERE text IS NOT NULL) GROUP BY silo""",
    "token_quality": f"""SELECT silo, count(*) FILTER (n > 64) AS over_64, count(*) FILTER (n > 96) AS over_96, count(*) FILTER (n > 128) AS over_128, round(100.0::DOUBLE * count(*) FILTER (n > 64) / count(*), 6) AS share_over
        FROM (SELECT silo, {_TOK} AS n FROM {_SILO} WHERE text IS NOT NULL) GROUP BY silo""",
    "size_histogram": f"""SELECT silo, count(*) FILTER (n < 100) AS under_100, count(*) FILTER (n >= 100 AND n < 300) AS from_100, count(*) FILTER (n >= 300 AND n < 600) AS from_300,
        count(*) FILTER (n >= 600 AND n <= 1000) AS from_600, count(*) FILTER (n > 1000) AS over_1000 FROM (SELECT silo, length(text) AS n FROM {_SILO} WHERE text IS NOT NULL) GROUP BY silo""",
    "dup_chunks": f"SELECT metadata.silo AS silo, count(*) AS chunks, count(*) - count(DISTINCT sha256({_TRIM.format('text')})) AS duplicates FROM document_chunk WHERE text IS NOT NULL GROUP BY 1",
    "coverage_intervals": f"""SELECT document_id, covered::BIGINT AS covered, (length - covered)::BIGINT AS lost, (inner_gaps + CASE WHEN length - reach > 10 THEN 1 ELSE 0 END)::BIGINT AS gaps, round(100.0::DOUBLE * covered / length, 6) AS coverage
        FROM (SELECT document_id, length(content) AS length FROM {DOCUMENTS} WHERE length(content) > 0) JOIN (
        SELECT document_id, sum(greatest(0, z - greatest(a, coalesce(before, 0)))) AS covered, sum(CASE WHEN before IS NULL THEN CASE WHEN a > 10 THEN 1 ELSE 0 END WHEN a > before THEN 1 ELSE 0 END) AS inner_gaps, max(z) AS reach FROM (
        SELECT document_id, start_char_offset AS a, end_char_offset AS z, max(end_char_offset) OVER (PARTITION BY document_id ORDER BY start_char_offset, end_char_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM {CHUNKS}) GROUP BY document_id) USING (document_id)""",
    "line_coverage": f"""SELECT document_id, count(*) AS lines, count(*) FILTER (found) AS found FROM (SELECT l.document_id, l.line, coalesce(bool_or(contains(c.text, l.line)), false) AS found
        FROM (SELECT DISTINCT document_id, {_TRIM.format('line')} AS line FROM (SELECT document_id, unnest(string_split(content, chr(10))) AS line FROM {DOCUMENTS} WHERE content IS NOT NULL)) l
        LEFT JOIN {CHUNKS} c ON c.document_id = l.document_id AND c.text IS NOT NULL WHERE l.line <> '' GROUP BY ALL) GROUP BY document_id""",
    "table_integrity": r"""SELECT kind, count(*) AS tables, count(*) FILTER (NOT sep) AS orphaned, count(*) FILTER (sep AND NOT coalesce(regexp_matches(rows[2], '^\|[\s:|-]*-[\s:|-]*\|$'), false)) AS broken FROM (
        SELECT kind, rows, len(list_filter(rows, lambda x: regexp_matches(x, '^\|[\s:|-]*-[\s:|-]*\|$'))) > 0 AS sep FROM (
        SELECT regexp_extract(source_path, '\.([^.]+)$', 1) AS kind, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: starts_with(x, '|')) AS rows
        FROM """ + DOCUMENTS + """ WHERE content IS NOT NULL) WHERE len(rows) > 0) GROUP BY kind""",
    "boundary_defects": rf"""SELECT silo, count(*) AS chunks, count(*) FILTER (regexp_matches(t, '^\p{{Ll}}')) AS starts_lower, count(*) FILTER (regexp_matches(t, '^[,.;:!?)]')) AS starts_mark, count(*) FILTER (suffix(t, '-')) AS ends_hyphen
        FROM (SELECT silo, {_TRIM.format('text')} AS t FROM {_SILO} WHERE text IS NOT NULL) WHERE t <> '' GROUP BY silo""",
    "metadata_faults": f"""SELECT document_id, count(*) FILTER (coalesce(trim(chunk_id) = '', true)) AS blank_ids, count(*) FILTER (chunk_index <> place) AS misplaced, count(*) FILTER (coalesce(trim(metadata.id) = '', true)) AS blank_metadata_ids,
        count(*) FILTER (coalesce(trim(metadata.title) = '', true)) AS blank_titles FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1 AS place FROM {CHUNKS}) GROUP BY document_id""",
    "retrieval_metrics": f"""SELECT count(*) AS queries, round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN f <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr,
        round(avg(g), 6) AS ndcg_10, round(avg(CASE WHEN f IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_hit FROM (SELECT query_id, min(CASE WHEN relevant THEN rank END) AS f,
        least(1.0::DOUBLE, sum(CASE WHEN relevant THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END)) AS g FROM {_JUDGED} GROUP BY query_id)""",
    "relevance_judgements": f"SELECT query_id, rank::BIGINT AS rank, chunk_id, relevant FROM {_JUDGED}",
    "answer_grounding": rf"""SELECT chunk_id, CASE WHEN {_TRIM.format('text')} = '' OR {_TRIM.format('context')} = '' THEN 0.0::DOUBLE WHEN len(w) = 0 THEN 1.0::DOUBLE
          ELSE round(len(list_filter(w, lambda x: contains(lower(context), x)))::DOUBLE / len(w), 6) END AS grounded,
        CASE WHEN {_TRIM.format('text')} = '' OR starts_with(lower(text), '[ошибка') THEN 0.0::DOUBLE ELSE round(len(list_filter(['quarterly', 'vault', 'bar'], lambda f: contains(lower(text), f)))::DOUBLE / 3, 6) END AS correct FROM (
        SELECT a.chunk_id, a.text, b.text AS context, list_filter(list_distinct(list_transform(regexp_extract_all(a.text, '[A-Za-zА-Яа-я0-9\-_:]{{4,}}'), lambda x: lower(x))), lambda x: NOT list_contains({E.STOP_WORDS}, x)) AS w
        FROM {_ANSWERED} a JOIN {_ANSWERED} b ON a.document_id = b.document_id AND a.chunk_index = b.chunk_index + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL)""",
    "extractive_answers": rf"""SELECT chunk_id, sha256(CASE WHEN len(held) > 0 THEN array_to_string(held, '. ') || '.' ELSE 'В предоставленном контексте найдены параметры документа, соответствующие запросу.' END) AS hash
        FROM (SELECT chunk_id, list_slice(list_filter(list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda x: {_TRIM.format('x')}), lambda x: x <> ''),
        lambda x: contains(lower(x), 'power feed') OR contains(lower(x), 'отчёт') OR contains(lower(x), 'rapport')), 1, 2) AS held FROM {CHUNKS} WHERE text IS NOT NULL)""",
    "cost_model": f"""SELECT silo, sum(n)::BIGINT AS tokens, sum(((n * 0.00 + n * 0.20 + 100 * 0.40) / 1000)::DECIMAL(18,6))::DECIMAL(28,6)::VARCHAR AS cost FROM (SELECT silo, {_TOK}::DECIMAL(18,0) AS n FROM {_SILO} WHERE text IS NOT NULL) GROUP BY silo""",
    "composite_score": rf"""SELECT silo, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 65 THEN 'fair' ELSE 'weak' END AS label FROM (SELECT silo, round(100 * (0.25::DOUBLE * chunk + 0.40::DOUBLE * coalesce(ndcg, 0.5::DOUBLE) + 0.25::DOUBLE * coalesce(correct, 0.5::DOUBLE) + 0.1::DOUBLE), 6) AS score
        FROM (SELECT silo, 1 - count(*) FILTER (regexp_matches(t, '^\p{{Ll}}'))::DOUBLE / count(*) AS chunk FROM (SELECT silo, {_TRIM.format('text')} AS t FROM {_SILO} WHERE text IS NOT NULL) WHERE t <> '' GROUP BY silo)
        LEFT JOIN (VALUES ('hr-policies', 0.7::DOUBLE, 0.6::DOUBLE), ('technical-docs', 0.9, NULL), ('legal-contracts', NULL, 0.9)) k(silo, ndcg, correct) USING (silo))""",
    "page_overlap": rf"""SELECT c.document_id, c.chunk_id, p.page_number FROM {CHUNKS} c JOIN (SELECT document_id, page_number, off AS a, coalesce(lead(off) OVER (PARTITION BY document_id ORDER BY off), 2147483647) AS z FROM (
        SELECT document_id, regexp_extract(line, '(\d+)', 1)::INTEGER AS page_number, off FROM {_OFF} WHERE regexp_matches(line, '(?i)^## Page\s+\d+'))) p ON c.document_id = p.document_id AND c.start_char_offset < p.z AND c.end_char_offset > p.a""",
    "section_asof": f"SELECT * FROM {_SECTIONS}",
    "element_attach": f"SELECT document_id, element_id, chunk_id, level FROM {_ATTACHED.replace('<elements>', _ELEMENTS)}",
    "chunk_places": f"SELECT chunk_id, array_to_string(pages, ',') AS pages, section FROM {_PLACES}",
    "multimodal_chunks": rf"""WITH e AS MATERIALIZED (SELECT * REPLACE (CASE WHEN line_no % 2 = 1 THEN '| ' || title || ' |' || chr(10) || '| --- |' ELSE 'Picture of ' || title END AS content),
          CASE WHEN line_no % 2 = 0 THEN 'Figure' ELSE 'Table' END AS kind FROM {_ELEMENTS}),
        f AS (SELECT c.chunk_id, e.kind, e.line_no, e.element_id, CASE WHEN contains(lower(coalesce(c.text, '')), lower('[' || kind || ' ' || e.element_id || ']')) OR contains(lower(coalesce(c.text, '')), lower(e.content))
            OR kind = 'Table' AND contains(lower(coalesce(c.text, '')), lower('| ' || title || ' |')) THEN '' WHEN kind = 'Table' THEN chr(10) || chr(10) || '[Table ' || e.element_id || ']' || chr(10) || e.content
            ELSE chr(10) || chr(10) || '[Figure ' || e.element_id || '] ' || e.content END AS added FROM {_ATTACHED.replace('<elements>', 'e')} a JOIN e USING (document_id, element_id) JOIN {CHUNKS} c ON c.chunk_id = a.chunk_id),
        g AS (SELECT chunk_id, string_agg(added, '' ORDER BY kind, line_no, element_id) AS added, count(*) FILTER (kind = 'Figure') AS figures, count(*) FILTER (kind = 'Table') AS tables FROM f GROUP BY chunk_id)
        SELECT c.chunk_id, sha256(CASE WHEN coalesce(added, '') <> '' THEN coalesce(text, '') || added ELSE text END) AS hash, coalesce(figures, 0) AS figures, coalesce(tables, 0) AS tables FROM {CHUNKS} c LEFT JOIN g USING (chunk_id)""",
    "element_nearest": f"""SELECT document_id, element_id, chunk_id FROM (SELECT e.document_id, e.element_id, c.chunk_id,
        row_number() OVER (PARTITION BY e.document_id, e.element_id ORDER BY abs(e.off - c.start_char_offset), c.chunk_index) AS r FROM {_ELEMENTS} e JOIN {CHUNKS} c USING (document_id)) WHERE r = 1""",
    "element_texts": f"""SELECT chunk_id, sha256(CASE WHEN contains(lower(text), lower('[Table t-' || chunk_id || ']')) OR contains(lower(text), lower(section)) THEN text
        ELSE text || chr(10) || chr(10) || '[Table t-' || chunk_id || ']' || chr(10) || section END) AS hash FROM {CHUNKS} c JOIN {_SECTIONS} x USING (document_id, chunk_id) WHERE text IS NOT NULL AND section IS NOT NULL""",
    "numbered_headings": rf"""SELECT document_id, line_no::INTEGER AS line_no, repeat('#', least(6, length(n) - length(replace(n, '.', '')) + 2)::INTEGER) || ' ' || {_TRIM.format('line')} AS made FROM (
        SELECT document_id, line_no, line, regexp_extract(line, '^\s*(\d+(?:\.\d+)*)\.?\s+\p{{Lu}}', 1) AS n FROM (SELECT document_id, line_no, regexp_replace(line, '^#+\s+', '') AS line FROM {_LINES.format('')}))
        WHERE n <> '' AND length(line) <= 120 AND NOT regexp_matches(line, '[.;,]\s*$')""",
    "graph_search": """WITH v AS (SELECT 'n' || n_nationkey AS id, 'Nation: ' || n_name AS text, lower(n_name) AS low FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region: ' || r_name, lower(r_name) FROM region),
        e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation), s AS (SELECT id FROM v WHERE contains(low, 'an') OR contains(low, 'asia')),
        h AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT b, 1 FROM e WHERE a IN (FROM s) UNION ALL SELECT a, 1 FROM e WHERE b IN (FROM s))
        SELECT id, rank::INTEGER AS rank, round(1.0::DOUBLE / rank, 6) AS score, text FROM (SELECT id, row_number() OVER (ORDER BY hop, id) AS rank, text FROM (SELECT id, min(hop) AS hop FROM h GROUP BY id) JOIN v USING (id))""",
    "graph_search_all": f"""WITH v AS MATERIALIZED {_ENTITIES}, e AS MATERIALIZED (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}), s AS (SELECT id FROM v WHERE contains(lower(name), 'an') OR contains(lower(name), 'asia')),
        h1 AS MATERIALIZED (SELECT DISTINCT b AS id FROM e WHERE a IN (FROM s)), h AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT b, 2 FROM e WHERE a IN (FROM h1))
        SELECT id, rank::INTEGER AS rank, round(1.0::DOUBLE / rank, 6) AS score, text FROM (SELECT id, row_number() OVER (ORDER BY hop, id) AS rank, type || ': ' || name AS text FROM (SELECT id, min(hop) AS hop FROM h GROUP BY id) JOIN v USING (id))""",
    "image_dedup": """SELECT document_id, page_number, image_id FROM (SELECT document_id, page_number, document_id || '-' || page_number AS image_id, row_number() OVER (PARTITION BY document_id, sha256(body) ORDER BY page_number, document_id || '-' || page_number) AS r
        FROM page_block WHERE octet_length(encode(body)) >= 600) WHERE r = 1""",
    "entity_dedup": f"""SELECT DISTINCT ON (lower(name)) id, type, name FROM (SELECT document_id AS id, metadata.document_type AS type, metadata.author AS name FROM {DOCUMENTS} WHERE metadata.author IS NOT NULL) ORDER BY lower(name), id""",
    "connected_components": f"SELECT id, min(id) OVER (PARTITION BY r) AS component FROM {_MEMBERS}",
    "khop_traverse": f"""WITH e AS MATERIALIZED (SELECT a, b FROM {_EDGES} UNION SELECT b, a FROM {_EDGES}), h0 AS (SELECT 'r' || r_regionkey AS id FROM region WHERE r_name LIKE 'A%'), h1 AS (SELECT DISTINCT b AS id FROM e JOIN h0 ON a = id),
        h2 AS (SELECT DISTINCT b AS id FROM e JOIN h1 ON a = id) SELECT id, min(hop)::INTEGER AS hop FROM (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""",
    "community_texts": f"""SELECT community_id, count(*) AS members, 'Members: ' || string_agg(m, ', ' ORDER BY m) AS text FROM (SELECT (dense_rank() OVER (ORDER BY component) - 1)::INTEGER AS community_id, 'Nation: ' || n_name AS m, id
        FROM (SELECT id, min(id) OVER (PARTITION BY r) AS component FROM {_MEMBERS}) JOIN nation ON id = 'n' || n_nationkey) GROUP BY community_id""",
    "community_texts_all": f"""SELECT community_id, block_no, count(*) AS members, 'Members: ' || string_agg(m, ', ' ORDER BY m, id) AS text FROM (SELECT community_id, ((row_number() OVER (PARTITION BY community_id ORDER BY m, id) - 1) // 500)::INTEGER AS block_no, m, id
        FROM (SELECT (dense_rank() OVER (ORDER BY component) - 1)::INTEGER AS community_id, type || ': ' || name AS m, id FROM (SELECT id, min(id) OVER (PARTITION BY r) AS component FROM {_MEMBERS}) JOIN {_ENTITIES} USING (id))) GROUP BY community_id, block_no""",
    "entity_texts": f"""SELECT document_id, concat_ws(': ', metadata.document_type, metadata.title) || ' (office=' || metadata.office || '; silo=' || metadata.silo || ')' AS text FROM {DOCUMENTS}
        WHERE metadata.silo IS NOT NULL AND metadata.office IS NOT NULL""",
    "heading_tree": f"""WITH RECURSIVE {_NODES}, ids AS (SELECT l.document_id, l.node_no, l.level, l.title, p.path, l.parent_no, {_SLUG} AS plain, sha256(l.body) AS hash FROM linked l JOIN paths p ON l.document_id = p.document_id AND l.node_no = p.node_no)
        SELECT document_id, node_no, level, title, path, parent_no, CASE WHEN n = 1 THEN plain ELSE plain || '#' || n END AS node_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY document_id, plain ORDER BY node_no) AS n FROM ids)""",
    "descendants": f"WITH RECURSIVE {_NODES} SELECT document_id, ancestor_no AS node_no, node_no AS descendant_no, distance AS depth FROM up",
    "ancestors": f"WITH RECURSIVE {_NODES} SELECT document_id, node_no, ancestor_no, distance FROM up",
    "siblings": f"""WITH RECURSIVE {_NODES} SELECT a.document_id, a.node_no, coalesce(string_agg(b.node_no::VARCHAR, ',' ORDER BY b.node_no), '') AS siblings
        FROM linked a LEFT JOIN linked b ON a.document_id = b.document_id AND a.parent_no IS NOT DISTINCT FROM b.parent_no AND a.node_no <> b.node_no GROUP BY a.document_id, a.node_no""",
    "cross_refs": (f"""WITH RECURSIVE {_NODES}, targets AS (SELECT document_id, 'Art' || regexp_extract(title, '^Article (\\d+)', 1) AS ref, min(node_no) AS target_no FROM nodes
        WHERE regexp_matches(title, '(?i)^Article\\s+\\d+') GROUP BY 1, 2),
        refs AS (SELECT DISTINCT document_id, node_no, 'Art' || regexp_extract(x, '(\\d+)', 1) AS ref FROM (SELECT document_id, node_no, unnest(regexp_extract_all(title || chr(10) || body, '(?i:Article\\s+\\d+)')) AS x FROM nodes))
        SELECT DISTINCT document_id, node_no, target_no FROM refs JOIN targets USING (document_id, ref) WHERE node_no <> target_no""").replace(
        "regexp_replace(content,", "regexp_replace(regexp_replace(regexp_replace(content, '(?m)^(#+) (\\d+)\\. ', '\\1 Article \\2 ', 'g'), '(?:Sec\\.|art\\.|ст\\.|п\\.) (\\d+)', 'Article \\1', 'g'),"),
    "formal_references": r"""SELECT document_id, array_to_string(list_sort(list_distinct(list_transform(m, lambda x: CASE WHEN starts_with(x, '§') THEN 'S' || regexp_extract(x, '([\d.]*\d)', 1) WHEN starts_with(lower(x), 'a') THEN 'Art' || regexp_extract(x, '(\d+)', 1)
        ELSE 'RFC' || regexp_extract(x, '(\d+)', 1) END))), ',') AS refs FROM (SELECT document_id, regexp_extract_all(regexp_replace(content, '(?:Sec\.|art\.|п\.) (\d+(?:\.\d+)?)', 'Article \1 and § \1', 'g'), '§\s*[\d.]*\d|(?i:Article\s+\d+|RFC\s*\d+)') AS m
        FROM """ + DOCUMENTS + """ WHERE content IS NOT NULL) WHERE len(m) > 0""",
    "version_guard": _GUARD.format(""),
    "version_guard_tenant": _GUARD.format("WHERE tenant_id = (SELECT min(tenant_id) FROM change_event)"),
    "latest_versions": "SELECT document_id, max(version) AS version, count(*) AS deliveries, count(DISTINCT version) AS versions FROM change_event GROUP BY document_id",
    "stream_version_guard": _GUARD.format(""),
    "conversation_ttl": f"""SELECT conversation_id, version, expires_at FROM (SELECT DISTINCT ON (document_id) document_id AS conversation_id, version, arrived_at + INTERVAL 30 DAY AS expires_at FROM change_event ORDER BY document_id, arrived_at DESC, seq DESC)
        WHERE expires_at > TIMESTAMP '{NOW}'""",
    "summary_cache_key": f"SELECT author, sha256(string_agg(document_id, chr(0) ORDER BY document_id)) AS key, count(*) AS members FROM {_AUTHORS} GROUP BY author",
    "summary_cache_evict": f"""SELECT author, sha256(string_agg(document_id, chr(0) ORDER BY document_id)) AS key FROM {_AUTHORS} GROUP BY author
        HAVING count(*) FILTER (document_id IN (SELECT document_id FROM change_event WHERE tenant_id IS NULL)) = 0""",
    "events_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "events_sessions": """SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
        SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, n""",
    "docx_scan": rf"""SELECT '/a/' || document_id || '.docx' AS source_path, NULL::VARCHAR AS error, length(regexp_replace(content, '[\s#\x0B\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '', 'g'))::BIGINT AS signs
        FROM {DOCUMENTS} WHERE length({_TRIM.format('content')}) > 0""",
    "xlsx_scan": rf"""SELECT '/a/' || document_id || '.xlsx' AS source_path, NULL::VARCHAR AS error, (len(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x, ' '), '|') AND NOT contains(x, '---'))) + 3)::BIGINT AS lines
        FROM {DOCUMENTS} WHERE suffix(source_path, '.xlsx') AND contains(content, '|')""",
}
