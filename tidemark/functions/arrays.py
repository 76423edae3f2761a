"""Arithmetic over arrays of numbers, within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale(a: Column, k: float) -> Column:
    """Every element times k."""
    return F.transform(a, lambda x: x * F.lit(float(k)))


def _pairwise(a: Column, b: Column, f) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def add(a: Column, b: Column) -> Column:
    """Element by element; null where the lengths differ."""
    return _pairwise(a, b, lambda x, y: x + y)


def mul(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def total(a: Column) -> Column:
    """The sum of what isn't null; 0 for an empty array."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def mean(a: Column) -> Column:
    """The mean of what isn't null; null without any."""
    n = F.size(F.filter(a, lambda x: x.isNotNull()))
    return F.when(n > 0, total(a) / n)


def count_above(a: Column, x: float) -> Column:
    return F.size(F.filter(a, lambda v: v > x)).cast("long")


def count_below(a: Column, x: float) -> Column:
    return F.size(F.filter(a, lambda v: v < x)).cast("long")
