"""Sets of series, as frames with a series_key: union, intersection, difference, and trees of conditions on tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ast
from . import selectors

KEY = "series_key"


def union(*sets: DataFrame) -> DataFrame:
    """Every series of any set, once."""
    return reduce(DataFrame.unionByName, [s.select(KEY) for s in sets]).distinct()


def intersection(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The series that all sets hold, once."""
    return reduce(lambda a, b: a.join(b.select(KEY), KEY, "left_semi"), others, first.select(KEY).distinct())


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The first set's series that no other holds, once."""
    return reduce(lambda a, b: a.join(b.select(KEY), KEY, "left_anti"), others, first.select(KEY).distinct())


def cardinality(series: DataFrame) -> DataFrame:
    """n: how many series the set has; with rows given twice counted once."""
    return series.agg(F.countDistinct(KEY).alias("n"))


def has_key(key: str) -> ast.Condition:
    return ast.TagMatcher(key, "exists")


def lacks_key(key: str) -> ast.Condition:
    return ast.TagMatcher(key, "not_exists")


def where(catalogue: DataFrame, condition: ast.Condition) -> DataFrame:
    """The series of a catalogue (series_key, metric, tags) that fit a tree of And, Or, Not over tag matchers."""
    fits: Column = selectors.condition(condition)
    return catalogue.where(F.coalesce(fits, F.lit(False))).select(KEY)


def active(catalogue: DataFrame, since: Column) -> DataFrame:
    """Series with a point at that time or later."""
    return catalogue.where(F.col("last_at") >= since)
