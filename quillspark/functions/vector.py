"""Vector expressions over array columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import SPARSE_SIZE, fnv1a, tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for null, empty or zero vectors and for vectors of different length."""
    size = norm(a) * norm(b)
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a)


def usable(a: Column, dimensions: int) -> Column:
    """Of the right length, without null, NaN or infinite elements, and not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(a) == dimensions) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for the row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sparse_counts(text: Column) -> Column:
    """Map from the hash of each token modulo SPARSE_SIZE to its number of occurrences."""
    hashed = F.array_sort(F.transform(tokens(text), lambda t: F.pmod(fnv1a(t), F.lit(SPARSE_SIZE))))

    def counts(h):
        # of sorted hashes, the count of each is how far apart its first and last places are
        last = lambda x: F.size(h) - F.array_position(F.reverse(h), x) + 1
        return F.map_from_entries(F.transform(F.array_distinct(h), lambda x: F.struct(x, (last(x) - F.array_position(h, x) + 1).cast("double"))))

    return let(hashed, counts)


def hash_embedding(text: Column, dimensions: int = 64) -> Column:
    """Deterministic stand-in embedder: token hashes folded into ``dimensions`` counts, unit length."""
    slots = F.transform(tokens(text), lambda t: F.pmod(fnv1a(t), F.lit(dimensions)))
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    counts = let(slots, lambda v: F.transform(places, lambda i: F.size(F.filter(v, lambda x: x == i)).cast("float")))
    return let(counts, l2_normalise)
