"""All core queries by name, each with the SQL that states the same result."""

from __future__ import annotations

from quillspark.plans import analysis, ingest, retrieval
from quillspark.plans.base import Query

MODULES = (retrieval, ingest, analysis)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
