"""Queries of retrieval, fusion and post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.predicates import where
from quillspark.functions.vector import sparse_counts
from quillspark.operators import retrieve as R
from quillspark.plans.base import (
    CHUNKS, QUESTION_ROWS, QUESTIONS, TOKENS, VECTORS, Query, bm25_sql, chunks, dense_sql, question_vectors, rrf_sql, typed, vectors,
)

TEXTS = [(q, t) for q, t, _ in QUESTIONS]
#: The pre-filter of the filtered searches.
FILTER = where(lambda m: ((m.silo == "technical-docs") | (m.silo == "hr-policies")) & (m.fiscal_year >= 2020))
FILTER_SQL = "(v.metadata.silo IN ('technical-docs', 'hr-policies') AND v.metadata.fiscal_year >= 2020)"
_TEXTED = f"(SELECT chunk_id, text FROM {VECTORS} WHERE text IS NOT NULL)"
_TEXTED_FILTERED = f"(SELECT chunk_id, text FROM {VECTORS} v WHERE text IS NOT NULL AND {FILTER_SQL})"
_ALL = f"(SELECT chunk_id, text FROM {CHUNKS} WHERE text IS NOT NULL)"


def _out(df):
    return typed(df, rank="bigint", score="double")


def _dense(s, d, k, filtered=False):
    v = vectors(s, d)
    return R.knn(v, question_vectors(v), k, FILTER if filtered else None)


def _texted(s, d):
    return vectors(s, d).where("text is not null")


def knn_cosine_topk(s, d):
    return _out(_dense(s, d, 10))


def knn_prefiltered(s, d):
    return _out(_dense(s, d, 10, True))


def bm25_topk(s, d):
    return _out(R.bm25(chunks(s, d).where("text is not null"), TEXTS, 10))


def bm25_prefix_topk(s, d):
    return _out(R.bm25(chunks(s, d).where("text is not null"), TEXTS, 10, prefix=True))


def hybrid_rrf_topk(s, d):
    v = vectors(s, d)
    top = R.hybrid(v, TEXTS, question_vectors(v), 10, FILTER)
    return typed(R.payload(top, v, ["document_id", "chunk_index"]), rank="bigint", score="double", chunk_index="int")


def _legs(s, d, k=40):
    return _dense(s, d, k), R.bm25(_texted(s, d), TEXTS, k)


_LEGS = [dense_sql(40), bm25_sql(40, _TEXTED)]


def hybrid_full_outer(s, d):
    return _out(R.rrf_full_outer(*_legs(s, d), 10))


def fusion_weighted(s, d):
    return _out(R.weighted(*_legs(s, d), 10))


def fusion_cascade(s, d):
    dense, sparse = _legs(s, d)
    # the dense list of two questions is cut short, so that both branches are taken
    short = dense.where(F.col("query_id").isin("q1", "q2") | (F.col("rank") <= 2))
    return _out(R.cascade(short, sparse, 10))


def rag_fusion_fold(s, d):
    dense, sparse = _legs(s, d, 20)
    return _out(R.fold([dense, sparse, R.bm25(_texted(s, d), TEXTS, 20, prefix=True)], 10))


def step_back(s, d):
    """The question and a general one (its longest words) fused."""
    general = [(q, " ".join(w for w in t.split() if len(w) > 6)) for q, t in TEXTS]
    rows = _texted(s, d)
    return _out(R.rrf([R.bm25(rows, TEXTS, 10), R.bm25(rows, general, 10)], 10))


def _general_sql() -> str:
    return "(VALUES " + ", ".join(f"('{q}', '{' '.join(w for w in t.split() if len(w) > 6)}', '')" for q, t in TEXTS) + ") q(query_id, words, department)"


def min_score_floor(s, d):
    return _out(R.min_score(_dense(s, d, 50), 0.5))


def context_interleave(s, d):
    return typed(R.interleave(_dense(s, d, 9)), rank="bigint", score="double", position="int")


def rerank_topk(s, d):
    """A stand-in cross-encoder: the share of the query's length in the text's."""
    rows = R.payload(_dense(s, d, 20), vectors(s, d), ["text"]).where("text is not null")
    score = F.pmod(F.length("text") * F.lit(37), F.lit(1000)) / F.lit(1000.0)
    return _out(R.rerank(rows, score, 5, floor=0.3))


def crag_filter(s, d):
    """Graded by a stand-in rule; a question that loses all results falls back to BM25."""
    rows = R.payload(_dense(s, d, 20), vectors(s, d), ["text"])
    bad = (F.col("query_id") == "q2") | F.coalesce(F.length("text") < 500, F.lit(True))
    graded = rows.withColumn("grade", F.when(bad, "INCORRECT").otherwise("CORRECT"))
    return _out(R.crag(graded, 10, R.bm25(_texted(s, d), TEXTS, 10)))


def mmr_select(s, d):
    return _out(R.mmr(R.payload(_dense(s, d, 20), vectors(s, d), ["vector"]), 5))


def sparse_vector_topk(s, d):
    """Dot product of hashed bags of words: chunks against the questions."""
    rows = chunks(s, d).where("text is not null").select("chunk_id", F.explode(sparse_counts(F.col("text"))).alias("slot", "value"))
    q = s.createDataFrame(TEXTS, "query_id string, words string").select("query_id", F.explode(sparse_counts(F.col("words"))).alias("slot", "weight"))
    return _out(R.sparse_dot(rows, q, 10))


def sparse_hash_vector(s, d):
    """Slots of every chunk, as a count and a sum that stand for the whole map."""
    m = sparse_counts(F.col("text"))
    rows = chunks(s, d).where("text is not null").select("chunk_id", m.alias("m"))
    total = F.aggregate(F.map_keys("m"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("chunk_id", F.size("m").cast("bigint").alias("slots"), total.alias("slot_sum"), F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x).alias("tokens"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"
_SLOTS = "list_transform({0}, lambda t: " + _FNV.format("t") + " % 1000000)"
_CHUNK_SLOTS = f"(SELECT chunk_id, {_SLOTS.format(TOKENS.format('text'))} AS slots FROM {CHUNKS} WHERE text IS NOT NULL)"

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        hybrid_rrf_topk, knn_cosine_topk, knn_prefiltered, bm25_topk, bm25_prefix_topk, hybrid_full_outer, fusion_weighted, fusion_cascade, rag_fusion_fold, step_back,
        min_score_floor, context_interleave, rerank_topk, crag_filter, mmr_select, sparse_vector_topk, sparse_hash_vector,
    )
}

_PAYLOAD = f"SELECT r.query_id, r.chunk_id, r.rank, r.score, {{0}} FROM {{1}} r JOIN {VECTORS} v USING (chunk_id)"


def _share(leg: str, weight: float) -> str:
    return f"""SELECT query_id, chunk_id, {weight} * (score - min(score) OVER (PARTITION BY query_id))
      / greatest(max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id), 1e-9) AS share FROM {leg}"""


_SHORT = f"(SELECT * FROM {_LEGS[0]} WHERE query_id IN ('q1', 'q2') OR rank <= 2)"

SQL: dict[str, str] = {
    "knn_cosine_topk": f"SELECT * FROM {dense_sql(10)}",
    "knn_prefiltered": f"SELECT * FROM {dense_sql(10, FILTER_SQL)}",
    "bm25_topk": f"SELECT * FROM {bm25_sql(10, _ALL)}",
    "bm25_prefix_topk": f"SELECT * FROM {bm25_sql(10, _ALL, True)}",
    "hybrid_rrf_topk": _PAYLOAD.format("v.document_id, v.chunk_index", rrf_sql([dense_sql(40, FILTER_SQL), bm25_sql(40, _TEXTED_FILTERED)], 10)),
    "hybrid_full_outer": f"""SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM (
        SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
        round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS score
        FROM {_LEGS[0]} a FULL OUTER JOIN {_LEGS[1]} b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)) WHERE rank <= 10""",
    "fusion_weighted": f"""SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM (
        SELECT query_id, chunk_id, round(sum(share), 6) AS score FROM ({_share(_LEGS[0], 0.5)} UNION ALL {_share(_LEGS[1], 0.5)}) GROUP BY ALL)) WHERE rank <= 10""",
    "fusion_cascade": f"""WITH a AS MATERIALIZED (SELECT * FROM {_SHORT}), full_ AS (SELECT query_id FROM a GROUP BY query_id HAVING count(*) >= 3)
        SELECT query_id, chunk_id, rank, score FROM a WHERE rank <= 10 AND query_id IN (SELECT query_id FROM full_)
        UNION ALL SELECT * FROM {rrf_sql(['a', _LEGS[1]], 10)} WHERE query_id NOT IN (SELECT query_id FROM full_)""",
    "rag_fusion_fold": f"SELECT * FROM {rrf_sql([rrf_sql([dense_sql(20), bm25_sql(20, _TEXTED)], 20), bm25_sql(20, _TEXTED, True)], 20)} WHERE rank <= 10",
    "step_back": f"SELECT * FROM {rrf_sql([bm25_sql(10, _TEXTED), bm25_sql(10, _TEXTED).replace(QUESTION_ROWS, _general_sql())], 10)}",
    "min_score_floor": f"SELECT * FROM {dense_sql(50)} WHERE score >= 0.5",
    "context_interleave": f"""SELECT query_id, chunk_id, rank, score, (CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2
        ELSE count(*) OVER (PARTITION BY query_id) - 1 - (rank - 2) // 2 END)::INTEGER AS position FROM {dense_sql(9)}""",
    "rerank_topk": f"""SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM (
        SELECT r.query_id, r.chunk_id, round(((length(v.text) * 37) % 1000) / 1000.0::DOUBLE, 6) AS score FROM {dense_sql(20)} r JOIN {VECTORS} v USING (chunk_id)
        WHERE v.text IS NOT NULL)) WHERE rank <= 5 AND score >= 0.3""",
    "crag_filter": f"""WITH kept AS MATERIALIZED (SELECT r.* FROM {dense_sql(20)} r JOIN {VECTORS} v USING (chunk_id) WHERE NOT (r.query_id = 'q2' OR coalesce(length(v.text) < 500, true)))
        SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, score FROM kept) WHERE rank <= 10
        UNION ALL SELECT * FROM {bm25_sql(10, _TEXTED)} WHERE query_id NOT IN (SELECT query_id FROM kept)""",
    "sparse_vector_topk": f"""SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, score FROM (
        SELECT query_id, chunk_id, round(sum(v.value::DOUBLE * q.weight), 6) AS score
        FROM (SELECT chunk_id, slot, count(*) AS value FROM (SELECT chunk_id, unnest(slots) AS slot FROM {_CHUNK_SLOTS}) GROUP BY ALL) v
        JOIN (SELECT query_id, slot, count(*) AS weight FROM (SELECT query_id, unnest({_SLOTS.format(TOKENS.format('words'))}) AS slot FROM {QUESTION_ROWS}) GROUP BY ALL) q USING (slot)
        GROUP BY ALL)) WHERE rank <= 10""",
    "sparse_hash_vector": f"""SELECT chunk_id, len(list_distinct(slots))::BIGINT AS slots, coalesce(list_sum(list_distinct(slots)), 0)::BIGINT AS slot_sum, len(slots)::DOUBLE AS tokens
        FROM {_CHUNK_SLOTS}""",
}
