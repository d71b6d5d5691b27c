"""Metadata predicates: a small tree that becomes one Spark column, and can be rendered.

Null follows the meaning of an in-process comparison: ``!=`` keeps nulls, NOT of an
unknown is true, range comparisons with null are false. String tests are case-sensitive.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metadata properties whose column has another name in rendered filters.
RENAMED = {"confidentiality_level": "confidentiality", "id": "document_id"}


class Predicate:
    def column(self, prefix: str = "metadata.") -> Column:
        raise NotImplementedError

    def render(self, style: str) -> str | None:
        """``sql``, ``odata`` or ``json`` text; None where the style can't express the predicate."""
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other, True)

    def __or__(self, other: Predicate) -> Predicate:
        return Both(self, other, False)

    def __invert__(self) -> Predicate:
        return Not(self)


def _sql(value: Any) -> str:
    if isinstance(value, bool):
        return "1 = 1" if value else "1 = 0"
    return f"'{value}'" if isinstance(value, date) else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


@dataclass
class Compare(Predicate):
    name: str
    op: str
    value: Any

    def column(self, prefix: str = "metadata.") -> Column:
        c = F.col(prefix + self.name)
        if self.value is None:
            if self.op not in ("==", "!="):
                raise ValueError("a range can't be compared with null")
            return c.isNull() if self.op == "==" else c.isNotNull()
        v = F.lit(self.value)
        plain = {"==": c == v, "!=": ~c.eqNullSafe(v), "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.op]
        return F.coalesce(plain, F.lit(False))

    def render(self, style: str) -> str | None:
        name = RENAMED.get(self.name, self.name)
        if style == "sql":
            if self.value is None:
                return f"{name} IS {'NOT ' * (self.op == '!=')}NULL"
            if self.op == "!=":
                return f"({name} <> {_sql(self.value)} OR {name} IS NULL)"
            return f"{name} {'=' if self.op == '==' else self.op} {_sql(self.value)}"
        if style == "odata":
            words = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
            return f"{name} {words[self.op]} {'null' if self.value is None else _sql(self.value)}"
        if self.op in ("==", "!="):
            match = {"key": name, "match": {"value": self.value}}
            return json.dumps(match if self.op == "==" else {"must_not": [match]}, default=str)
        if not isinstance(self.value, (int, float)):
            return None  # ranges are of numbers
        return json.dumps({"key": name, "range": {{"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}[self.op]: self.value}})


@dataclass
class TextTest(Predicate):
    name: str
    test: str
    value: str

    def column(self, prefix: str = "metadata.") -> Column:
        c = F.col(prefix + self.name)
        out = {"contains": c.contains, "startswith": c.startswith, "endswith": c.endswith, "equals": c.__eq__}[self.test](F.lit(self.value))
        return F.coalesce(out, F.lit(False))

    def render(self, style: str) -> str | None:
        if style != "sql":
            return None
        v = self.value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("'", "''")
        shape = {"contains": f"%{v}%", "startswith": f"{v}%", "endswith": f"%{v}", "equals": v}[self.test]
        return f"{RENAMED.get(self.name, self.name)} LIKE '{shape}' ESCAPE '\\'"


@dataclass
class OneOf(Predicate):
    name: str
    values: list[Any]

    def column(self, prefix: str = "metadata.") -> Column:
        kept = [v for v in self.values if v is not None]
        return F.coalesce(F.col(prefix + self.name).isin(*kept), F.lit(False)) if kept else F.lit(False)

    def render(self, style: str) -> str | None:
        kept = [v for v in self.values if v is not None]
        name = RENAMED.get(self.name, self.name)
        if style == "json":
            return json.dumps({"key": name, "match": {"any": kept}})
        if style == "odata":
            return "(" + " or ".join(f"{name} eq {_sql(v)}" for v in kept) + ")" if kept else "false"
        return f"{name} IN ({', '.join(map(_sql, kept))})" if kept else "1 = 0"


@dataclass
class Both(Predicate):
    left: Predicate
    right: Predicate
    conjunction: bool

    def column(self, prefix: str = "metadata.") -> Column:
        a, b = self.left.column(prefix), self.right.column(prefix)
        return a & b if self.conjunction else a | b

    def render(self, style: str) -> str | None:
        a, b = self.left.render(style), self.right.render(style)
        if a is None or b is None:
            return None
        if style == "json":
            return json.dumps({"must" if self.conjunction else "should": [json.loads(a), json.loads(b)]})
        word = ("AND" if self.conjunction else "OR") if style == "sql" else ("and" if self.conjunction else "or")
        return f"({a} {word} {b})"


@dataclass
class Not(Predicate):
    inner: Predicate

    def column(self, prefix: str = "metadata.") -> Column:
        return ~self.inner.column(prefix)

    def render(self, style: str) -> str | None:
        a = self.inner.render(style)
        return f"NOT ({a})" if a is not None and style == "sql" else None


@dataclass
class Constant(Predicate):
    value: bool

    def column(self, prefix: str = "metadata.") -> Column:
        return F.lit(self.value)

    def render(self, style: str) -> str | None:
        return _sql(self.value) if style == "sql" else None


@dataclass
class Custom(Predicate):
    """Any Python test of a metadata row; evaluated in Arrow batches, before any limit."""

    test: Callable[[dict], bool]

    def column(self, prefix: str = "metadata.") -> Column:
        test = self.test

        @F.udf("boolean", useArrow=True)
        def run(row):
            return bool(row is not None and test(row.asDict() if hasattr(row, "asDict") else row))

        return run(F.col(prefix.rstrip(".")))

    def render(self, style: str) -> None:
        return None


class Field:
    def __init__(self, name: str):
        self.name = name

    def __eq__(self, v):  # type: ignore[override]
        return Compare(self.name, "==", v)

    def __ne__(self, v):  # type: ignore[override]
        return Compare(self.name, "!=", v)

    def __lt__(self, v):
        return Compare(self.name, "<", v)

    def __le__(self, v):
        return Compare(self.name, "<=", v)

    def __gt__(self, v):
        return Compare(self.name, ">", v)

    def __ge__(self, v):
        return Compare(self.name, ">=", v)

    __hash__ = None  # type: ignore[assignment]

    def contains(self, v: str) -> Predicate:
        return TextTest(self.name, "contains", v)

    def startswith(self, v: str) -> Predicate:
        return TextTest(self.name, "startswith", v)

    def endswith(self, v: str) -> Predicate:
        return TextTest(self.name, "endswith", v)

    def equals(self, v: str) -> Predicate:
        return TextTest(self.name, "equals", v)

    def isin(self, values) -> Predicate:
        return OneOf(self.name, list(values))


def where(test: Callable[[Any], Predicate]) -> Predicate:
    """``where(lambda m: (m.silo == "hr") & (m.fiscal_year >= 2020))``."""

    class Row:
        def __getattr__(self, name: str) -> Field:
            return Field(name)

    return test(Row())


ALL = Constant(True)
