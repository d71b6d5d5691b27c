"""Retrieval over many queries at once: results are ``(query_id, chunk_id, rank, score)``.

Every ranking is a total order: score descending, then chunk id. Scores are rounded to
six places before they rank, so that the order doesn't hang on the last bits of a sum.
Top-k keeps rows by row_number, which Spark limits in each partition before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.predicates import Predicate
from quillspark.functions.vector import dot, norm
from quillspark.operators import index
from quillspark.runtime import ship

PLACES = 6


def ranked(scores: DataFrame, k: int | None = None, by: list[Column] | None = None) -> DataFrame:
    """Add ``rank`` from 1 within each query; keep the first ``k``."""
    order = Window.partitionBy("query_id").orderBy(*(by or [F.desc("score"), F.col("chunk_id")]))
    out = scores.withColumn("rank", F.row_number().over(order))
    out = out if k is None else out.where(F.col("rank") <= k)
    return out.select("query_id", "chunk_id", "rank", "score")


def knn(vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int, where: Predicate | None = None) -> DataFrame:
    """Exact cosine search of the given query vectors, after the predicate.

    The queries are part of the plan (a request's vectors, not a table), so the scan meets
    all of them at once and nothing is joined; norms of the queries are computed here.
    """
    rows = vectors if where is None else vectors.where(where.column())
    if not queries:
        return rows.select(F.lit("").alias("query_id"), "chunk_id", F.lit(0).alias("rank"), F.lit(0.0).alias("score")).where("false")
    parts = []
    for name, v in queries:
        size = float(np.sqrt(np.sum(np.square(np.array(v, np.float64)))))
        score = F.when((norm(F.col("vector")) > 0) & F.lit(size > 0), dot(F.col("vector"), F.lit([float(x) for x in v])) / (norm(F.col("vector")) * F.lit(size or 1.0))).otherwise(0.0)
        parts.append(F.struct(F.lit(name).alias("query_id"), F.round(score, PLACES).alias("score")))
    scored = rows.select("chunk_id", F.inline(F.array(*parts)))
    return ranked(scored.select("query_id", "chunk_id", "score"), k)


def query_terms(queries: list[tuple[str, str]], spark) -> DataFrame:
    """``(query_id, term, times)`` of the query texts; repeated terms count repeatedly."""
    rows = spark.createDataFrame(queries, "query_id string, query string")
    return rows.select("query_id", F.explode(X.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25(chunks: DataFrame, queries: list[tuple[str, str]], k: int | None, prefix: bool = False, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of the query texts over ``(chunk_id, text)``.

    Only postings of query terms are built: the terms of a request are few, and are broadcast
    as they come from the plan. ``prefix`` lets a query term of two characters or more match
    every term that it begins, as a group of its own. Chunks without any match have no row.
    """
    terms = query_terms(queries, chunks.sparkSession)
    tokens = chunks.select("chunk_id", X.tokens(F.col("text")).alias("tokens"))
    stats = tokens.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total"))
    long = tokens.select("chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    if prefix:
        terms = terms.where(F.length("term") >= 2)
        met = long.join(F.broadcast(terms), F.col("token").startswith(F.col("term")))
    else:
        met = long.join(F.broadcast(terms), F.col("token") == F.col("term"))
    tf = met.groupBy("query_id", "term", "times", "chunk_id", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    joined = tf.join(F.broadcast(df), ["query_id", "term"]).withColumns({c: stats.select(c).scalar() for c in ("n", "total")})
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    average = F.greatest(F.col("total") / F.col("n"), F.lit(1.0))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average)) * F.col("times")
    scores = joined.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), PLACES).alias("score")).where("score > 0")
    return ranked(scores, k)


def rrf(results: list[DataFrame], k: int | None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (constant + rank) over the lists."""
    parts = None
    for r in results:
        one = r.select("query_id", "chunk_id", (1.0 / (constant + F.col("rank"))).alias("share"))
        parts = one if parts is None else parts.unionByName(one)
    scores = parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("share"), PLACES).alias("score"))
    return ranked(scores, k)


def rrf_full_outer(dense: DataFrame, sparse: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """The same for two lists, by a full outer join; a list without the chunk adds nothing."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    share = F.coalesce(1.0 / (constant + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (constant + F.col("sparse_rank")), F.lit(0.0))
    return ranked(both.select("query_id", "chunk_id", F.round(share, PLACES).alias("score")), k)


def _normalised(result: DataFrame, weight: float) -> DataFrame:
    of_query = Window.partitionBy("query_id")
    low, high = F.min("score").over(of_query), F.max("score").over(of_query)
    return result.select("query_id", "chunk_id", (weight * (F.col("score") - low) / F.greatest(high - low, F.lit(1e-9))).alias("share"))


def weighted(a: DataFrame, b: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Sum of min-max normalised scores; a list of one or of equal scores adds 0."""
    parts = _normalised(a, weight).unionByName(_normalised(b, 1 - weight))
    return ranked(parts.groupBy("query_id", "chunk_id").agg(F.round(F.sum("share"), PLACES).alias("score")), k)


def cascade(a: DataFrame, b: DataFrame, k: int, enough: int = 3) -> DataFrame:
    """List ``a`` where it has ``enough`` results for a query, the fusion of both elsewhere."""
    full = a.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("query_id")
    first = a.join(full, "query_id", "left_semi").where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score")
    return first.unionByName(rrf([a, b], k).join(full, "query_id", "left_anti"))


def fold(results: list[DataFrame], k: int) -> DataFrame:
    """Left fold of pairwise fusion at 2k: only ranks survive each step, so this is not the fusion of all lists at once."""
    merged = results[0]
    for r in results[1:]:
        merged = rrf([merged, r], 2 * k)
    return merged.where(F.col("rank") <= k)


def min_score(result: DataFrame, floor: float) -> DataFrame:
    """Drop results under the floor; a floor of 0 or less lets all pass. Ranks are kept."""
    return result if floor <= 0 else result.where(F.col("score") >= floor)


def interleave(result: DataFrame) -> DataFrame:
    """Positions that put the best at both ends: even places (from 0) to the front, odd ones to the back."""
    r, n = F.col("rank") - 1, F.count("*").over(Window.partitionBy("query_id"))
    place = F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor((r - 1) / 2))
    return result.withColumn("position", place.cast("int"))


def rerank(result: DataFrame, score: Column, k: int, candidates: int = 20, floor: float = 0.0) -> DataFrame:
    """Take max(candidates, k) results, order them by another score, keep k, drop those under the floor."""
    taken = result.where(F.col("rank") <= max(candidates, k)).withColumn("score", F.round(score, PLACES))
    return min_score(ranked(taken.select("query_id", "chunk_id", "score"), k), floor)


def crag(graded: DataFrame, k: int, fallback: DataFrame | None = None) -> DataFrame:
    """Drop results graded INCORRECT, keep the order; a query that loses all takes the fallback's results."""
    kept = graded.where(F.upper("grade") != "INCORRECT").select("query_id", "chunk_id", "rank", "score")
    order = [F.col("rank")]
    out = ranked(kept, k, order)
    if fallback is not None:
        out = out.unionByName(ranked(fallback.select("query_id", "chunk_id", "rank", "score").join(kept.select("query_id").distinct(), "query_id", "left_anti"), k, order))
    return out


def mmr(candidates: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over ``(query_id, chunk_id, score, vector)``: greedy, the first of equals wins.

    The choice is sequential within a query; a query's candidates are a bounded over-fetch.
    The score that comes out is the relevance, the rank is the order of choice.
    """
    ship(candidates.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack([np.asarray(v, np.float64) for v in pdf["vector"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        relevance, nearest = pdf["score"].to_numpy(np.float64), np.zeros(len(pdf))
        left, chosen = np.ones(len(pdf), bool), []
        for _ in range(min(k, len(pdf))):
            value = np.where(left, np.round(balance * relevance - (1 - balance) * nearest, 9), -np.inf)
            i = int(value.argmax())
            chosen.append(i)
            left[i] = False
            nearest = np.maximum(nearest, x @ x[i])
        out = pdf.iloc[chosen]
        return pd.DataFrame({"query_id": out["query_id"], "chunk_id": out["chunk_id"], "rank": np.arange(1, len(out) + 1, dtype=np.int32), "score": out["score"]})

    rows = candidates.select("query_id", "chunk_id", "score", "vector")
    return rows.groupBy("query_id").applyInPandas(run, "query_id string, chunk_id string, rank int, score double")


def sparse_dot(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Dot product of sparse vectors ``(chunk_id, slot, value)`` with ``(query_id, slot, weight)`` rows."""
    met = vectors.join(F.broadcast(queries), "slot")
    return ranked(met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("value") * F.col("weight")), PLACES).alias("score")), k)


def payload(result: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Add columns of the chunks; the result is at most k rows a query and is the side that is broadcast."""
    return F.broadcast(result).join(table.select("chunk_id", *columns), "chunk_id")


def hybrid(
    chunks: DataFrame, texts: list[tuple[str, str]], vectors: list[tuple[str, list[float]]], k: int, where: Predicate | None = None, over_fetch: int = 4
) -> DataFrame:
    """Filter, dense and BM25 legs of max(4k, k + 5) candidates, fusion, top k; without query terms the dense leg alone."""
    rows = chunks if where is None else chunks.where(where.column())
    n = max(over_fetch * k, k + 5)
    dense = knn(rows, vectors, n)
    words = [(q, t) for q, t in texts if any(c.isalnum() for c in t)]
    if not words:
        return dense.where(F.col("rank") <= k)
    return rrf([dense, bm25(rows.where(F.col("text").isNotNull()), words, n)], k)


def term_postings(chunks: DataFrame) -> DataFrame:
    return index.postings(chunks)
