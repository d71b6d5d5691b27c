"""Views of the project's tables that many queries share, as frames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.vector import usable
from quillspark.runtime import table

Query = Callable[[SparkSession, str], DataFrame]

MODEL, DIMENSIONS = "emb-local-64", 64
#: Questions of the example retrieval, as (id, words, department whose mean vector is the query's vector).
QUESTIONS = [
    ("q1", "annual vendor annex of the finance team", "Finance"),
    ("q2", "quarterly power feed, power feed and turbine housing", "Engineering"),
    ("q3", "контроллер ночной смены и журнал", "HR"),
    ("q4", "registre annuel de la filiale", "Legal"),
]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_chunk, each chunk once."""
    return table(spark, sf_dir, "document_chunk").dropDuplicates(["chunk_id"])


CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM document_chunk)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of loaded_document: (document_id, metadata, content, source_path, lang_label)."""
    loaded = table(spark, sf_dir, "loaded_document")
    row = F.max_by(F.struct("metadata", "content", "source_path", "lang_label"), "loaded_at").alias("row")
    return loaded.groupBy(F.col("metadata.id").alias("document_id")).agg(row).select("document_id", "row.*")


DOCUMENTS = "(SELECT DISTINCT ON (metadata.id) metadata.id AS document_id, metadata, content, source_path, lang_label FROM loaded_document ORDER BY metadata.id, loaded_at DESC)"


def vectors(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Latest usable row of each chunk of one model in embedded_chunk."""
    rows = table(spark, sf_dir, "embedded_chunk").where((F.col("model_id") == model) & usable(F.col("vector"), DIMENSIONS))
    row = F.max_by(F.struct("document_id", "chunk_index", "text", "metadata", "vector"), "embedded_at").alias("row")
    return rows.groupBy("chunk_id").agg(row).select("chunk_id", "row.*")


VECTORS = f"""(SELECT DISTINCT ON (chunk_id) chunk_id, document_id, chunk_index, text, metadata, vector FROM embedded_chunk
  WHERE model_id = '{MODEL}' AND len(vector) = {DIMENSIONS} AND list_sum(list_transform(vector, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
  AND list_max(list_transform(vector, lambda x: abs(x))) > 0 ORDER BY chunk_id, embedded_at DESC)"""


def question_vectors(rows: DataFrame) -> list[tuple[str, list[float]]]:
    """Mean vector of the chunks of each question's department, rounded: a stand-in for an embedded question.

    One row of DIMENSIONS numbers for each of the few departments comes to the driver.
    """
    wanted = sorted({d for _, _, d in QUESTIONS})
    parts = rows.where(F.col("metadata.department").isin(*wanted)).select(F.col("metadata.department").alias("d"), F.posexplode("vector").alias("i", "x"))
    mean = parts.groupBy("d", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    found = {r["d"]: [x["m"] for x in r["v"]] for r in mean.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).collect()}
    return [(q, found[d]) for q, _, d in QUESTIONS if d in found]


QUESTION_ROWS = "(VALUES " + ", ".join(f"('{q}', '{t}', '{d}')" for q, t, d in QUESTIONS) + ") q(query_id, words, department)"
#: (query_id, m list<double>)
QUESTION_VECTORS = f"""(SELECT q.query_id, list(m ORDER BY i) AS m FROM
  (SELECT d, i, round(avg(x), 6) AS m FROM (SELECT metadata.department AS d, unnest(range(1, {DIMENSIONS + 1})) AS i, unnest(vector)::DOUBLE AS x FROM {VECTORS})
   GROUP BY d, i) v JOIN {QUESTION_ROWS} ON q.department = v.d GROUP BY q.query_id)"""


def dense_sql(k: int, where: str = "true") -> str:
    """Ranked dense leg: (query_id, chunk_id, rank, score)."""
    score = "round(CASE WHEN list_sum(list_transform(v.vector, lambda x: x::DOUBLE * x::DOUBLE)) > 0 THEN list_cosine_similarity(v.vector::DOUBLE[], q.m) ELSE 0 END, 6)"
    return f"""(SELECT query_id, chunk_id, rank, score FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT q.query_id, v.chunk_id, {score} AS score FROM {VECTORS} v, {QUESTION_VECTORS} q WHERE {where})) WHERE rank <= {k})"""


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{Nd}}_]+')"


def bm25_sql(k: int | None, source: str, prefix: bool = False) -> str:
    """Ranked BM25 leg over the (chunk_id, text) rows of ``source``."""
    match = "starts_with(t.token, qt.term) AND length(qt.term) >= 2" if prefix else "t.token = qt.term"
    limit = f"WHERE rank <= {k}" if k is not None else ""
    return f"""(WITH src AS MATERIALIZED (SELECT chunk_id, {TOKENS.format('text')} AS toks FROM {source}),
      n AS (SELECT count(*)::DOUBLE AS n, sum(len(toks))::DOUBLE AS total FROM src),
      t AS (SELECT chunk_id, len(toks) AS length, unnest(toks) AS token FROM src),
      qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format('words')}) AS term FROM {QUESTION_ROWS}) GROUP BY ALL),
      tf AS (SELECT query_id, term, times, chunk_id, length, count(*) AS tf FROM t JOIN qt ON {match} GROUP BY ALL),
      df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL),
      sc AS (SELECT query_id, chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(total / n, 1))) * times), 6) AS score
             FROM tf JOIN df USING (query_id, term), n GROUP BY ALL)
      SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM sc WHERE score > 0) {limit})"""


def rrf_sql(legs: list[str], k: int | None) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS share FROM {leg}" for leg in legs)
    limit = f"WHERE rank <= {k}" if k is not None else ""
    return f"""(SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score
      FROM (SELECT query_id, chunk_id, round(sum(share), 6) AS score FROM ({union}) GROUP BY ALL)) {limit})"""


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
