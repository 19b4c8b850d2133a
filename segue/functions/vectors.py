"""Fixed-length feature vectors held as ARRAY<DOUBLE>; an empty array means unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR_SLOTS = 16


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, terms)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays.

    A fold, not 16 unrolled terms: unrolled, the generated method is too large
    for the JVM's compiler and runs interpreted, many times slower.
    """
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column, n: int) -> Column:
    """Euclidean length; NULL if the vector is missing, not of length n, or zero."""
    length = F.sqrt(dot(a, a))
    return F.when((F.size(a) == n) & (length > 0), length)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays of any length, clamped to 0..1, NULL if undefined."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    defined = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (length > 0)
    return F.when(defined, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / length)))


def cyclic_cosine(a: Column, b: Column, shifts: tuple[int, ...] = (0, 4, 8, 12)) -> Column:
    """Best cosine over whole-beat rotations of b."""
    turned = [cosine(a, b if s == 0 else F.concat(
        F.slice(b, F.size(b) - s + 1, s), F.slice(b, F.lit(1), F.size(b) - s))) for s in shifts]
    return F.when((F.size(a) == BAR_SLOTS) & (F.size(b) == BAR_SLOTS), F.greatest(*turned))


def texture_similarity(a: Column, b: Column) -> Column:
    """Unclamped cosine without coefficient 0 (loudness); 0 if undefined."""
    def tail(v):
        return F.when(F.size(v) > 2, F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))).otherwise(v)

    x, y = tail(a), tail(b)
    length = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    defined = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (length > 0)
    return F.coalesce(F.when(defined, dot(x, y) / length), F.lit(0.0))


def syncopation(pattern: Column) -> Column:
    """Share of off-beat energy on the eighth-note slots of a 16-slot bar."""
    on = _sum([F.get(pattern, F.lit(i)) for i in (0, 4, 8, 12)])
    off = _sum([F.get(pattern, F.lit(i)) for i in (2, 6, 10, 14)])
    return F.coalesce(F.when((F.size(pattern) >= BAR_SLOTS) & (on + off > 0), off / (on + off)), F.lit(0.0))
