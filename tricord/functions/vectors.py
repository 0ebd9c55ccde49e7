"""Arithmetic on arrays of doubles as column expressions, and sums of arrays over groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def axpy(a: Column, factor: Column, b: Column) -> Column:
    """a + factor * b."""
    return F.zip_with(a, b, lambda x, y: x + factor * y)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def sum_vectors(name: str, rank: int) -> Column:
    """An aggregate: the sum of the arrays of a group, an element each in the map-side buffer."""
    return F.array(*[F.sum(F.get(F.col(name), F.lit(k))) for k in range(rank)])


def non_zeros(a: Column) -> Column:
    return F.size(F.filter(a, lambda v: v != 0))
