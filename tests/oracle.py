"""Compare a query with its SQL: rows, columns and values, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings loaded_document page_block document_chunk embedded_chunk "
    "sqlite_vector_store change_event language_ref pack_capacity"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(_value(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _value(x)) for k, x in sorted(v.items()))
    return v


def rows_of(names: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql: str, folder: str, con=None) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or connect(folder)).execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} and {len(theirs[1])} rows; mine {mine[1][:2]}, theirs {theirs[1][:2]}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows differ, first: {str(bad[0][0])[:300]} and {str(bad[0][1])[:300]}" if bad else ""
