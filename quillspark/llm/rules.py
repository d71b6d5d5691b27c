"""Decision lists by sequential covering: grow a conjunction, prune it, cover, go on.

Each rule is a conjunction of threshold conditions on numeric columns. It is grown on
two thirds of the rows that are left by the condition of greatest information gain,
pruned on the other third, and kept while it is right for most rows it covers. The
list becomes one ordered Spark ``CASE`` expression, evaluated in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log2

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RULES, MAX_CONDITIONS = 12, 5
#: Thresholds tried for one column; quantiles where the sample has more distinct values.
MAX_THRESHOLDS = 256


@dataclass(frozen=True)
class Condition:
    column: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        values = x[:, names.index(self.column)]
        return values >= self.threshold if self.above else values < self.threshold

    def expression(self) -> Column:
        c = F.col(self.column)
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.column} {'>=' if self.above else '<'} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules for the positive class, tried in order; rows that meet none are negative."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def expression(self) -> Column:
        """Number of the first rule that holds, from 1; null where none does."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            meets = reduce(lambda a, b: a & b, (c.expression() for c in self.rules[k - 1]))
            out = F.when(meets, F.lit(k)).otherwise(out)
        return out

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x, names) for c in rule])
        return out

    def __str__(self) -> str:
        return "\n".join(f"{k}: " + " and ".join(map(str, r)) for k, r in enumerate(self.rules, 1))


def _thresholds(values: np.ndarray, offered: list[float]) -> list[float]:
    distinct = np.unique(values)
    middle = (distinct[1:] + distinct[:-1]) / 2
    if len(middle) > MAX_THRESHOLDS:
        middle = np.unique(np.quantile(middle, np.linspace(0, 1, MAX_THRESHOLDS)))
    return [*offered, *middle.tolist()]  # at a tie the first wins: an offered threshold


def _best(x: np.ndarray, y: np.ndarray, names: list[str], offered: dict[str, list[float]]) -> Condition | None:
    """The condition of greatest FOIL gain over rows ``x`` with labels ``y``."""
    p, n = int(y.sum()), int(len(y) - y.sum())
    if not p:
        return None
    base, best, gain = log2(p / (p + n)), None, 1e-9
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        values, hits = x[order, j], np.concatenate(([0], np.cumsum(y[order])))
        for t in _thresholds(values, offered.get(name, [])):
            k = int(np.searchsorted(values, t, "left"))
            below_p = int(hits[k])
            for above, pp, total in ((True, p - below_p, len(y) - k), (False, below_p, k)):
                if pp and (g := pp * (log2(pp / total) - base)) > gain:
                    best, gain = Condition(name, above, float(t)), g
    return best


def _worth(rule: list[Condition], x: np.ndarray, y: np.ndarray, names: list[str]) -> float:
    """(p - n) / (p + n) of the covered rows, the pruning measure; ties go to the shorter rule."""
    if not rule:
        return -1.0
    covered = np.logical_and.reduce([c.holds(x, names) for c in rule])
    total = int(covered.sum())
    return (2 * int(y[covered].sum()) - total) / total if total else -1.0


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], offered: dict[str, list[float]], rows: np.ndarray) -> list[Condition]:
    """A conjunction that holds for positive cases of ``rows`` alone, or as far as it gets."""
    rule: list[Condition] = []
    inside = np.ones(len(rows), bool)
    while len(rule) < MAX_CONDITIONS and y[rows[inside]].any() and not y[rows[inside]].all():
        c = _best(x[rows[inside]], y[rows[inside]], names, offered)
        if c is None or c in rule:
            break
        rule.append(c)
        inside &= c.holds(x[rows], names)
    if not rule and y[rows].all():
        # nothing but positive cases: the loosest condition that holds for all of them
        rule = [Condition(names[0], True, float(x[rows, 0].min()))] if len(rows) else []
    return rule


def learn(x: np.ndarray, y: np.ndarray, names: list[str], offered: dict[str, list[float]] | None = None, seed: int = 7) -> DecisionList:
    """Learn a list for ``y``. An empty sample, or one without positives, falls back to the offered thresholds."""
    offered, out = offered or {}, DecisionList()
    y = np.asarray(y, bool)
    if not y.any():
        out.rules = [(Condition(name, True, t),) for name, ts in offered.items() for t in ts]
        return out
    random = np.random.default_rng(seed)
    left = np.ones(len(y), bool)
    while (y & left).any() and len(out.rules) < MAX_RULES:
        rows = np.flatnonzero(left)
        part = random.random(len(rows)) < 2 / 3
        # where two thirds give no good rule, as with few cases left, all rows grow one and none prunes it
        for grow, prune in ((rows[part], rows[~part]), (rows, rows[:0])):
            rule = _grow(x, y, names, offered, grow)
            if rule and y[prune].any():
                lengths = range(1, len(rule) + 1)
                rule = rule[: max(lengths, key=lambda k: (_worth(rule[:k], x[prune], y[prune], names), -k))]
            covered = np.logical_and.reduce([c.holds(x, names) for c in rule]) & left if rule else np.zeros(len(y), bool)
            if covered.any() and y[covered].mean() >= 0.5:
                break
        else:
            break
        out.rules.append(tuple(rule))
        left &= ~covered
    return out
