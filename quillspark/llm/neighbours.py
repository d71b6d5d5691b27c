"""Problem 7: most similar vectors, by shifted space-filling curves.

Equal vectors of a model are one class. Every class is put on several Hilbert curves,
each over another random projection with another shift; the curves are range-partitioned
and sorted by Spark, and each class meets the classes in a window after it. Pairs whose
compact codes are similar enough are merged over the curves and reranked by the exact
cosine. A class that meets many similar ones lies in a crowd which windows can't see
whole; such classes are searched exactly among all of their model. Recall is measured
in tests and in the README; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.hilbert import hilbert_keys
from quillspark.runtime import checkpoint, ship, shuffle_partitions

DIMENSIONS, NEAREST, LEAST_COSINE = 64, 5, 0.90
#: Curves, coordinates and bits of each, and how far a class looks along a curve.
CURVES, AXES, BITS, WINDOW = 14, 16, 3, 24
#: By how much the cosine of two codes (64 bytes) may fall short of that of the vectors.
CODE_SLACK = 0.02
#: A class with so many similar partners on the curves is searched exactly.
CROWDED = 2 * NEAREST
#: Crowded classes that one task of the exact search holds, and rows of a matrix product there.
HELD, STEP = 32768, 2048
SEED = 20


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, and which rows are usable: finite and not all zero."""
    x = x.astype(np.float64)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    x = np.where(ok[:, None], x, 1.0)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4"), ok


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Rows of fixed width of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(dtype).reshape(len(column), width)


def _from_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the lists of the right length without null elements."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    where = np.flatnonzero(lengths == DIMENSIONS)
    values = column.take(pa.array(where)).flatten().cast(pa.float64())
    return where, values.to_numpy(zero_copy_only=False).reshape(len(where), DIMENSIONS)  # null elements become NaN


def _from_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = column.to_pylist()
    where = [i for i, b in enumerate(rows) if b is not None and len(b) == 4 * DIMENSIONS]
    data = b"".join(rows[i] for i in where)
    return np.array(where, np.int64), np.frombuffer(data, "<f4").reshape(len(where), DIMENSIONS)


def _usable(df: DataFrame, decode) -> DataFrame:
    """Keep the rows of ``(chunk_id, model_id, at, vector)`` with a usable vector, as unit float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, x = decode(batch.column(3))
            if not len(where):
                continue
            x, ok = _unit(x)
            keep = pa.array(where[ok])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(keep) for k in range(3)), _binary(x[ok])], ["chunk_id", "model_id", "at", "vector"])

    rows = df.where(F.col("vector").isNotNull() & F.col("chunk_id").isNotNull() & F.col("model_id").isNotNull())
    return rows.mapInArrow(run, "chunk_id string, model_id string, at bigint, vector binary")


def current_vectors(embedded: DataFrame, stored: DataFrame) -> DataFrame:
    """``(chunk_id, model_id, vector)``: of each chunk and model the latest usable row of ``embedded``, else the stored one.

    A null embedded_at counts as the oldest. Rows without chunk_id or model_id have no vector.
    """
    ship(embedded.sparkSession)
    at = F.coalesce(F.unix_micros(F.col("embedded_at").cast("timestamp")), F.lit(-(1 << 62)))
    a = _usable(embedded.select("chunk_id", "model_id", at.alias("at"), "vector"), _from_lists)
    b = _usable(stored.select("chunk_id", "model_id", F.lit(-(1 << 63)).cast("bigint").alias("at"), "vector"), _from_bytes)
    latest = F.max_by("vector", F.struct("at", "vector")).alias("vector")
    return a.unionByName(b).groupBy("chunk_id", "model_id").agg(latest)


def classes(vectors: DataFrame) -> DataFrame:
    """``(class_id, model_id, vector)``: one row for all chunks of an equal vector, combined before the shuffle."""
    return vectors.groupBy("class_id").agg(F.first("model_id").alias("model_id"), F.first("vector").alias("vector"))


def first_members(vectors: DataFrame) -> DataFrame:
    """``(class_id, first_ids)``: the NEAREST + 1 smallest chunk ids, all that a ranking among copies needs.

    The limit of the window is applied before the shuffle, so a large class doesn't gather.
    """
    order = F.row_number().over(Window.partitionBy("class_id").orderBy("chunk_id"))
    ranked = vectors.select("class_id", "chunk_id").withColumn("r", order).where(F.col("r") <= NEAREST + 1)
    return ranked.groupBy("class_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("first_ids"))


def _curves() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    axes = [np.linalg.qr(random.normal(size=(DIMENSIONS, DIMENSIONS)))[0][:, :AXES] for _ in range(CURVES)]
    return np.stack(axes).astype(np.float32), random.uniform(0, 1, size=(CURVES, AXES)).astype(np.float32)


def on_curves(rows: DataFrame) -> DataFrame:
    """``(curve, model, key, class_id, code)``: each class on every curve, with its vector as 64 signed bytes."""
    axes, shifts = _curves()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = float(1 << BITS)
        for batch in batches:
            x = _matrix(batch.column(2), "<f4", DIMENSIONS)
            code = _binary(np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8))
            for c in range(CURVES):
                # coordinates of unit vectors have a spread of 1/sqrt(64); cells cover 3.5 of it on either side
                y = (x @ axes[c]) * np.float32(np.sqrt(DIMENSIONS)) + np.float32(3.5) + (shifts[c] - np.float32(0.5))
                grid = np.clip(y * np.float32(cells / 7.0), 0, cells - 1).astype(np.uint8)
                key = hilbert_keys(grid, BITS)
                curve = np.full(len(x), c, np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(curve), batch.column(1), pa.array(key), batch.column(0), code], ["curve", "model", "key", "class_id", "code"])

    source = rows.select("class_id", F.xxhash64("model_id").alias("model"), "vector")
    return source.mapInArrow(run, "curve tinyint, model bigint, key bigint, class_id bigint, code binary")


def window_pairs(curves: DataFrame, least: float, partitions: int) -> DataFrame:
    """Distinct ``(a, b)`` of class ids that lie within the window on some curve and whose codes are similar."""
    floor = np.float32(least - CODE_SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            x = _matrix(batch.column(4), "i1", DIMENSIONS).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), x)
            old = 0
            if last is not None:
                old = len(last[0])
                now = tuple(np.concatenate(p) for p in zip(last, now))
            curve, model, ids, x = now
            found = []
            for step in range(1, WINDOW + 1):
                first = max(0, old - step)
                if first + step >= len(ids):
                    break
                a, b = slice(first, len(ids) - step), slice(first + step, None)
                near = np.einsum("ij,ij->i", x[a], x[b]) >= floor
                near &= (curve[a] == curve[b]) & (model[a] == model[b])
                k = np.flatnonzero(near) + first
                found.append(np.stack([ids[k], ids[k + step]]))
            last = tuple(p[-WINDOW:] for p in now)
            if found:
                both = np.concatenate(found, 1)
                low, high = both.min(0), both.max(0)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    ordered = curves.repartitionByRange(partitions, "curve", "model", "key").sortWithinPartitions("curve", "model", "key")
    return ordered.select("curve", "model", "key", "class_id", "code").mapInArrow(run, "a bigint, b bigint").distinct()


def exact_cosines(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """``(a, b, cosine)`` of the pairs that reach ``least``, from the whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(k), "<f4", DIMENSIONS).astype(np.float64) for k in (2, 3))
            cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            keep = pa.array(np.flatnonzero(cosine >= least - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(cosine).take(keep)], ["a", "b", "cosine"])

    left = rows.select(F.col("class_id").alias("a"), F.col("vector").alias("x"))
    right = rows.select(F.col("class_id").alias("b"), F.col("vector").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a bigint, b bigint, cosine double")


def crowded_classes(pairs: DataFrame) -> DataFrame:
    """``(class_id)`` of the classes with at least CROWDED partners in ``pairs``."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id"))
    return ends.groupBy("class_id").agg(F.count("*").alias("n")).where(F.col("n") >= CROWDED).select("class_id")


def _best(cosine: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Columns of the NEAREST greatest of each row, of equal ones those of the least place."""
    if cosine.shape[1] > 8 * NEAREST:
        # no column under the row's NEAREST-th greatest counts; ties at it all stay
        fifth = np.partition(cosine, -NEAREST, axis=1)[:, -NEAREST]
        some = cosine >= fifth[:, None]
        width = int(some.sum(1).max())
        if width <= 8 * NEAREST:
            cols = np.argsort(~some, axis=1, kind="stable")[:, :width]
            row = np.arange(len(cols))[:, None]
            return cols[row, np.lexsort((place[cols], -cosine[row, cols]), axis=1)[:, :NEAREST]]
    return np.lexsort((np.broadcast_to(place, cosine.shape), -cosine), axis=1)[:, :NEAREST]


def crowd_search(crowded: DataFrame, rows: DataFrame, firsts: DataFrame, least: float, partitions: int) -> DataFrame:
    """``(a, b, cosine)``: for each class of ``crowded`` its NEAREST most similar classes ``b`` of the model, if at least ``least``.

    The crowded classes are held in parts of about HELD; all classes stream past each part
    in salted blocks, each task keeping a running best NEAREST of every class it holds. Equal
    cosines (at twelve places) rank by the smallest chunk id of the class (``firsts``).
    """
    count = crowded.count()
    source = rows.join(firsts, "class_id").select("class_id", F.xxhash64("model_id").alias("model"), "first", "vector")
    parts = max(1, -(-count // HELD))
    salts = max(1, -(-partitions // parts))
    hashed = F.xxhash64("class_id", F.lit(SEED))
    part, salt = F.pmod(hashed, F.lit(parts)), F.pmod(F.shiftright(hashed, 20), F.lit(salts))
    asked = source.join(crowded, "class_id").select("*", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("passing"))
    passing = source.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), salt.alias("salt"), F.lit(True).alias("passing"))
    columns = [F.col("part").cast("int").alias("part"), F.col("salt").cast("int").alias("salt"), "passing", "class_id", "model", "first", "vector"]
    both = asked.select(*columns).unionByName(passing.select(*columns)).repartition(partitions, "part", "salt").sortWithinPartitions("part", "salt", "passing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, best = None, [], None

        def result() -> pa.RecordBatch:
            ids, _, _, cosine, other, first = best
            row, col = np.nonzero(cosine >= least - 1e-9)
            columns = [pa.array(ids[row]), pa.array(other[row, col]), pa.array(cosine[row, col]), pa.array(first[row, col].tolist(), pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "cosine", "first"])

        def begin() -> tuple:
            ids, models, x = (np.concatenate(c) for c in zip(*held))
            shape = (len(ids), NEAREST)
            return ids, models, x, np.full(shape, -2.0), np.zeros(shape, np.int64), np.full(shape, "", object)

        for batch in batches:
            where = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            passes = batch.column(2).to_numpy(zero_copy_only=False)
            ids, models, names = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            x = _matrix(batch.column(6), "<f4", DIMENSIONS).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            change = (where[1:] != where[:-1]).any(1) | (passes[1:] != passes[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if group != tuple(where[lo]):
                    if best is not None:
                        yield result()
                    group, held, best = tuple(where[lo]), [], None
                if not passes[lo]:
                    held.append((ids[lo:hi], models[lo:hi], x[lo:hi]))
                    continue
                if best is None:
                    if not held:
                        continue
                    best = begin()
                for m in range(lo, hi, STEP):
                    n = min(hi, m + STEP)
                    for i in range(0, len(best[0]), STEP):
                        q = slice(i, i + STEP)
                        cosine = np.round(best[2][q] @ x[m:n].T, 12)
                        cosine[(best[1][q][:, None] != models[m:n][None]) | (best[0][q][:, None] == ids[m:n][None])] = -2
                        place = np.argsort(np.argsort(names[m:n], kind="stable"), kind="stable")
                        col = _best(cosine, place)
                        new = np.take_along_axis(cosine, col, 1)
                        # the running best of each row and those of this block, ranked together
                        c = np.concatenate([best[3][q], new], 1)
                        o = np.concatenate([best[4][q], ids[m:n][col]], 1)
                        f = np.concatenate([best[5][q], names[m:n][col]], 1)
                        rank = np.unique(f, return_inverse=True)[1].reshape(f.shape)
                        keep = np.lexsort((rank, -c), axis=1)[:, :NEAREST]
                        for k, v in ((3, c), (4, o), (5, f)):
                            best[k][q] = np.take_along_axis(v, keep, 1)
        if best is not None:
            yield result()

    found = both.mapInArrow(run, "a bigint, b bigint, cosine double, first string")
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "first")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= NEAREST).select("a", "b", "cosine")


def similar_pairs(embedded: DataFrame, stored: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``(chunk_id_a, chunk_id_b)``, the smaller id first: cosine of at least ``least`` under one model,
    and either among the NEAREST most similar of the other, where equal cosines rank by chunk id.

    Unusable vectors (null, of another length, with a null or non-finite element, all
    zero) take no part. Of many chunks of one vector only the links that the ranking
    asks for come out, at most NEAREST for each chunk, never all pairs.
    """
    spark = embedded.sparkSession
    vectors = current_vectors(embedded, stored)
    vectors = checkpoint(vectors.withColumn("class_id", F.xxhash64("model_id", "vector")))
    rows = classes(vectors)
    ids = first_members(vectors)
    pairs = checkpoint(window_pairs(on_curves(rows), least, shuffle_partitions(spark)))
    crowded = checkpoint(crowded_classes(pairs))
    some = not crowded.isEmpty()
    if some:
        # the ranking of a crowded class comes from the exact search, that of the others from the curves
        marked = [crowded.select(F.col("class_id").alias(e), F.lit(True).alias(f"{e}_crowded")) for e in "ab"]
        pairs = pairs.join(marked[0], "a", "left").join(marked[1], "b", "left").where("a_crowded is null or b_crowded is null").select("a", "b")
    linked = exact_cosines(pairs, rows, least)
    either = F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    both = linked.select(F.inline(either))
    if some:
        firsts = vectors.groupBy("class_id").agg(F.min("chunk_id").alias("first"))
        searched = crowd_search(crowded, rows, firsts, least, shuffle_partitions(spark))
        both = both.join(crowded.withColumnRenamed("class_id", "a"), "a", "left_anti").unionByName(searched)
    # for each class its own first members and those of the classes nearest to it; a class
    # beyond the NEAREST nearest can't be among the NEAREST most similar of any member
    near = both.join(ids.withColumnRenamed("class_id", "b"), "b")
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), F.col("first_ids")[0])
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= NEAREST)
    options = F.flatten(F.collect_list(F.transform("first_ids", lambda i: F.struct((-F.col("cosine")).alias("rank"), i.alias("id")))))
    near = near.groupBy(F.col("a").alias("class_id")).agg(options.alias("others"))
    own = F.when(F.size("first_ids") > 1, F.transform("first_ids", lambda i: F.struct(F.lit(-2.0).alias("rank"), i.alias("id"))))
    lists = ids.join(near, "class_id", "left").withColumn("own", own).where(F.col("own").isNotNull() | F.col("others").isNotNull())
    empty = F.expr("cast(array() as array<struct<rank:double,id:string>>)")
    lists = lists.select("class_id", F.concat(F.coalesce("own", empty), F.coalesce("others", empty)).alias("options"))
    mine = vectors.select("chunk_id", "class_id").join(lists, "class_id")
    best = F.slice(F.array_sort(F.filter("options", lambda o: o["id"] != F.col("chunk_id"))), 1, NEAREST)
    links = mine.select("chunk_id", F.explode(best).alias("o")).select("chunk_id", F.col("o.id").alias("other"))
    return links.select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b")).distinct()


#: Neighbours that each curve proposes for a class, and those that are reranked over all curves.
PROPOSED, RERANKED = 6, 24


def curve_neighbours(curves: DataFrame, partitions: int) -> DataFrame:
    """``(a, b, near)``: for each class the PROPOSED most similar others in a window of WINDOW on either side, by their codes, on each curve.

    Windows end at the borders of the range partitions, a few in all the rows of a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0  # rows that are still needed, and how many of them have come out

        def result(curve, model, ids, x, first: int, last: int) -> pa.RecordBatch:
            n, wide = len(ids), np.full((len(ids), 2 * WINDOW), -2, np.float32)
            other = np.zeros((n, 2 * WINDOW), np.int64)
            for step in range(1, min(WINDOW, n - 1) + 1):
                near = np.einsum("ij,ij->i", x[:-step], x[step:])
                near[(curve[:-step] != curve[step:]) | (model[:-step] != model[step:])] = -2
                wide[:-step, step - 1], other[:-step, step - 1] = near, ids[step:]
                wide[step:, WINDOW + step - 1], other[step:, WINDOW + step - 1] = near, ids[:-step]
            wide, other, mine = wide[first:last], other[first:last], ids[first:last]
            col = np.argpartition(-wide, PROPOSED - 1, axis=1)[:, :PROPOSED]
            near = np.take_along_axis(wide, col, 1)
            row, place = np.nonzero(near > -2)
            return pa.RecordBatch.from_arrays([pa.array(mine[row]), pa.array(other[row, col[row, place]]), pa.array(near[row, place])], ["a", "b", "near"])

        for batch in batches:
            x = _matrix(batch.column(4), "i1", DIMENSIONS).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(), x)
            if held is not None:
                now = tuple(np.concatenate(p) for p in zip(held, now))
            last = len(now[0]) - WINDOW
            if last > done:
                yield result(*now, done, last)
                done = last
            drop = max(0, done - WINDOW)
            held, done = tuple(p[drop:] for p in now), done - drop
        if held is not None and done < len(held[0]):
            yield result(*held, done, len(held[0]))

    ordered = curves.repartitionByRange(partitions, "curve", "model", "key").sortWithinPartitions("curve", "model", "key")
    return ordered.select("curve", "model", "key", "class_id", "code").mapInArrow(run, "a bigint, b bigint, near float")


def nearest_on_curves(embedded: DataFrame, stored: DataFrame, k: int = NEAREST) -> DataFrame:
    """``(chunk_id, model_id, rank, neighbour_id, cosine)``: the ``k`` most similar chunks of the same model that the curves meet, for every chunk.

    The proposals of all curves are merged, the RERANKED best by their codes get their exact
    cosine. Copies of a vector are one class; of a class the k + 1 smallest chunk ids
    stand for all in the ranking. Equal cosines (at nine places) rank by chunk id. Unusable
    vectors take no part; a chunk without any other of its model has no row. What share of
    the true nearest comes out hangs on how far they are: see the README.
    """
    spark = embedded.sparkSession
    vectors = checkpoint(current_vectors(embedded, stored).withColumn("class_id", F.xxhash64("model_id", "vector")))
    rows, ids = classes(vectors), first_members(vectors)
    proposed = curve_neighbours(on_curves(rows), shuffle_partitions(spark))
    best = proposed.groupBy("a", "b").agg(F.max("near").alias("near"))
    order = Window.partitionBy("a").orderBy(F.desc("near"), "b")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= RERANKED).select("a", "b")
    near = exact_cosines(best, rows, -1.0).join(ids.withColumnRenamed("class_id", "b"), "b")
    entry = lambda c: F.transform("first_ids", lambda i: F.struct((-F.round(c, 9)).alias("rank"), i.alias("id")))
    options = near.groupBy(F.col("a").alias("class_id")).agg(F.flatten(F.collect_list(entry(F.col("cosine")))).alias("others"))
    empty = F.expr("cast(array() as array<struct<rank:double,id:string>>)")
    lists = ids.join(options, "class_id", "left").select("class_id", F.concat(entry(F.lit(1.0)), F.coalesce("others", empty)).alias("options"))
    mine = vectors.select("chunk_id", "model_id", "class_id").join(lists, "class_id")
    top = F.slice(F.array_sort(F.filter("options", lambda o: o["id"] != F.col("chunk_id"))), 1, k)
    out = mine.select("chunk_id", "model_id", F.posexplode(top).alias("rank", "o"))
    return out.select("chunk_id", "model_id", (F.col("rank") + 1).alias("rank"), F.col("o.id").alias("neighbour_id"), (-F.col("o.rank")).alias("cosine"))


#: Vectors of a block of the exact search.
BLOCK = 2048


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows ``(chunk_id, model, vector)`` packed into blocks of at most BLOCK, numbered within the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.slice(start, BLOCK)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(k)) for k in (0, 1)]
                x = _matrix(part.column(2), "<f4", DIMENSIONS)
                yield pa.RecordBatch.from_arrays([*lists, pa.array([x.tobytes()], pa.binary())], ["ids", "models", "matrix"])

    packed = rows.select("chunk_id", "model", "vector").mapInArrow(run, "ids array<string>, models array<bigint>, matrix binary")
    return packed.toDF(f"{name}_ids", f"{name}_models", f"{name}_matrix")


def nearest(embedded: DataFrame, stored: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """``(chunk_id, model_id, rank, neighbour_id, cosine)``: the exact ``k`` most similar of the same model for each query row.

    ``is_query`` is a condition on chunk_id that states the query set. The queries go in
    blocks against all rows in blocks, each pair of blocks one matrix product that keeps k
    a query; equal cosines (at nine places) rank by chunk id. This measures what
    the curves find, and serves where neighbours are far.
    """
    vectors = checkpoint(current_vectors(embedded, stored).withColumn("model", F.xxhash64("model_id")))
    asked = vectors.where(is_query)
    query = checkpoint(_blocks(asked, "q").withColumn("number", F.monotonically_increasing_id()))
    numbers = query.select("number")
    # a table of query blocks' numbers: one for BLOCK queries
    base = _blocks(vectors, "b").withColumn("numbers", numbers.agg(F.array_sort(F.collect_list("number")).alias("n")).scalar())
    pairs = base.withColumn("number", F.explode("numbers")).drop("numbers").repartition("number", "b_ids").join(query, "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                b_ids, b_models, q_ids, q_models = (np.array(batch.column(c)[i].as_py()) for c in (0, 1, 3, 4))
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), "<f4").reshape(-1, DIMENSIONS).astype(np.float64) for c in (2, 5))
                cosine = np.round(y @ x.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None], 9)
                cosine[(q_models[:, None] != b_models[None]) | (q_ids[:, None] == b_ids[None])] = -2
                place = np.argsort(np.argsort(b_ids, kind="stable"), kind="stable")
                order = np.lexsort((np.broadcast_to(place, cosine.shape), -cosine), axis=1)[:, :k]
                row = np.repeat(np.arange(len(q_ids)), order.shape[1])
                col = order.ravel()
                keep = cosine[row, col] > -2
                row, col = row[keep], col[keep]
                columns = [pa.array(q_ids[row].tolist(), pa.string()), pa.array(q_models[row]), pa.array(b_ids[col].tolist(), pa.string()), pa.array(cosine[row, col])]
                yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "model", "neighbour_id", "cosine"])

    columns = ["b_ids", "b_models", "b_matrix", "q_ids", "q_models", "q_matrix"]
    found = pairs.select(*columns).mapInArrow(run, "chunk_id string, model bigint, neighbour_id string, cosine double")
    order = Window.partitionBy("chunk_id", "model").orderBy(F.desc("cosine"), "neighbour_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("chunk_id", "model", "model_id")
    return top.join(names, ["chunk_id", "model"]).select("chunk_id", "model_id", "rank", "neighbour_id", "cosine")
