"""SQL of the pN_ queries that SQL can state on whole tables, for DuckDB."""

from __future__ import annotations

from quillspark.llm.budget import DEPARTMENTS, TYPES


def _case(value: str, names: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _spelling(column: str, names: dict[str, str]) -> str:
    letters = rf"regexp_replace(lower({column}), '[^\p{{L}}]', '', 'g')"
    return f"coalesce({_case(letters, names)}, nullif(trim({column}, ' '), ''), 'unknown')"


def _language(column: str) -> str:
    text = f"lower(trim({column}, ' '))"
    return f"coalesce((SELECT any_value(lang) FROM names WHERE name = {text}), (SELECT any_value(lang) FROM names WHERE name = trim(regexp_replace({text}, '[-_].*', ''), ' ')), 'unknown')"


_TYPES = {t.lower(): t for t in TYPES}

_NORMAL = "trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
# of a content one character a UTF-16 unit: two dashes stand for one beyond the first plane
_UNITS = r"regexp_replace(content, '[\x{10000}-\x{10FFFF}]', '--', 'g')"
_WORD = r"'^[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}]$'"


def _inside(offset: str) -> str:
    return f"({offset} > 0 AND {offset} < length(u) AND regexp_matches(substring(u, {offset}, 2), {_WORD}))"


def _floats(column: str) -> str:
    """The little-endian float32 numbers of a blob of 256 bytes."""
    byte = lambda k: f"('0x' || substring(hex({column}), 8 * i + {2 * k + 1}, 2))::BIGINT"
    bits = f"({byte(3)} * 16777216 + {byte(2)} * 65536 + {byte(1)} * 256 + {byte(0)})"
    value = """CASE WHEN (b // 8388608) % 256 = 255 THEN NULL WHEN (b // 8388608) % 256 = 0 THEN (b % 8388608) * pow(2.0::DOUBLE, -149)
      ELSE (1 + (b % 8388608) / 8388608.0::DOUBLE) * pow(2.0::DOUBLE, (b // 8388608) % 256 - 127) END * CASE WHEN b >= 2147483648 THEN -1 ELSE 1 END"""
    return f"list_transform(list_transform(range(0, 64), lambda i: {bits}), lambda b: {value})"


_USABLE = "len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"
_VECTORS = f"""vectors AS MATERIALIZED (SELECT chunk_id, model_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM (
      SELECT DISTINCT ON (chunk_id, model_id) chunk_id, model_id, v FROM (
        SELECT chunk_id, model_id, vector::DOUBLE[] AS v, 1 AS origin, embedded_at AS made_at FROM embedded_chunk WHERE vector IS NOT NULL
        UNION ALL SELECT chunk_id, model_id, {_floats('vector')}, 0, NULL FROM sqlite_vector_store WHERE octet_length(vector) = 256) WHERE {_USABLE}
      ORDER BY chunk_id, model_id, origin DESC, made_at DESC NULLS LAST))"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS i, t FROM (SELECT DISTINCT {_NORMAL} AS t FROM document_chunk WHERE text IS NOT NULL) WHERE length(t) >= 5),
      grams AS MATERIALIZED (SELECT DISTINCT i, hash(substring(t, p, 5)) AS g FROM (SELECT i, t, unnest(range(1, length(t) - 3)) AS p FROM texts)),
      sizes AS (SELECT i, count(*) AS n FROM grams GROUP BY i),
      pairs AS (SELECT a.i AS a, b.i AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.i < b.i GROUP BY ALL),
      near AS (SELECT a, b FROM pairs JOIN sizes x ON x.i = a JOIN sizes y ON y.i = b WHERE c >= 0.66::DOUBLE * (x.n + y.n - c) UNION ALL SELECT i, i FROM texts),
      m AS (SELECT DISTINCT chunk_id, document_id, i FROM (SELECT chunk_id, document_id, {_NORMAL} AS t FROM document_chunk WHERE text IS NOT NULL) JOIN texts USING (t))
      SELECT DISTINCT least(x.chunk_id, y.chunk_id) AS chunk_id_a, greatest(x.chunk_id, y.chunk_id) AS chunk_id_b FROM near JOIN m x ON x.i = a JOIN m y ON y.i = b WHERE x.document_id <> y.document_id""",
    "p5_found": f"""WITH c AS (SELECT *, lag(end_char_offset) OVER (PARTITION BY document_id ORDER BY chunk_index) AS before, lag(chunk_index) OVER (PARTITION BY document_id ORDER BY chunk_index) AS one_before FROM (SELECT DISTINCT ON (chunk_id) * FROM document_chunk)),
      d AS (SELECT document_id, {_UNITS} AS u FROM (SELECT DISTINCT ON (metadata.id) metadata.id AS document_id, content FROM loaded_document ORDER BY metadata.id, loaded_at DESC))
      SELECT chunk_id FROM c LEFT JOIN d USING (document_id) WHERE end_char_offset - start_char_offset > 1000 OR coalesce({_inside('start_char_offset')} OR {_inside('end_char_offset')}, false)
        OR chunk_index >= 1 AND one_before = chunk_index - 1 AND (before - start_char_offset < 20 OR before - start_char_offset > 200)""",
    "p7_found": f"""WITH {_VECTORS}, pairs AS (SELECT a.chunk_id AS a, b.chunk_id AS b, a.model_id AS m, round(list_dot_product(a.v, b.v), 6) AS c FROM vectors a JOIN vectors b ON a.model_id = b.model_id AND a.chunk_id <> b.chunk_id),
      top AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a, m ORDER BY c DESC, b) AS r FROM pairs) WHERE r <= 5 AND c >= 0.9)
      SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM top""",
    "p6_deltas": f"""WITH names AS (SELECT DISTINCT lang, lower(trim(n, ' ')) AS name FROM (SELECT lang, unnest([lang, iso3, name, native_name]) AS n FROM language_ref) WHERE n <> ''),
      labels AS (SELECT DISTINCT ON (metadata.id) metadata.id AS document_id, lang_label FROM loaded_document ORDER BY metadata.id, loaded_at DESC),
      items AS (
        SELECT 'chunks' AS corpus, coalesce(c.metadata.silo, 'unknown') AS source, {_language('l.lang_label')} AS language, {_spelling('c.metadata.department', DEPARTMENTS)} AS department,
          {_spelling('c.metadata.document_type', _TYPES)} AS document_type, coalesce(octet_length(encode(c.text)), 0) AS n
        FROM (SELECT DISTINCT ON (chunk_id) * FROM document_chunk) c LEFT JOIN labels l USING (document_id)
        WHERE c.document_id NOT IN (SELECT document_id FROM change_event WHERE tenant_id IS NULL AND document_id IS NOT NULL)
        UNION ALL SELECT 'documents', coalesce(source, 'unknown'), {_language('d.lang')}, {_spelling('department', DEPARTMENTS)}, {_spelling('document_type', _TYPES)}, coalesce(octet_length(encode(text)), 0) FROM documents d)
      SELECT corpus, source, language, department, document_type, count(*)::BIGINT AS items, sum(n)::BIGINT AS tokens, grouping_id(source, language, department, document_type)::INTEGER AS level
      FROM items GROUP BY corpus, CUBE (source, language, department, document_type)""",
}
