"""Grouping by tags, and aggregates across series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..model import at_micros, micros
from ..plans import ast
from . import windows


def tag_columns(keys: tuple[str, ...], missing: str = "") -> list[Column]:
    return [F.coalesce(F.col("tags")[k], F.lit(missing)).alias(k) for k in keys]


def by_tags(points: DataFrame, calls: tuple[ast.Call, ...], keys: tuple[str, ...], missing: str = "") -> DataFrame:
    """A row per combination of tag values, in columns named as the tags."""
    rows = points.select("*", *tag_columns(keys, missing))
    return windows.aggregates(rows, calls, list(keys))


def by_tags_with_total(points: DataFrame, calls: tuple[ast.Call, ...], keys: tuple[str, ...]) -> DataFrame:
    """by_tags() and one row of the whole, from the same scan: `is_total`, and null tags in the total."""
    rows = points.select("*", *tag_columns(keys))
    named = [aggregate(c.function, c.arg).alias(c.name) for c in calls]
    sets = [[F.col(k) for k in keys], []]
    return rows.groupingSets(sets, *keys).agg((F.grouping_id() > 0).alias("is_total"), *named)


def by_bucket_with_total(points: DataFrame, calls: tuple[ast.Call, ...], interval_ms: int, start_ms: int) -> DataFrame:
    """Buckets and, with a null bucket, the value of the whole range, from one scan."""
    rows = points.withColumn("bucket", windows.tumbling(interval_ms, start_ms))
    return rows.rollup("bucket").agg(*[aggregate(c.function, c.arg).alias(c.name) for c in calls])


def instant(points: DataFrame, call: ast.Call) -> DataFrame:
    """One aggregate over all points of all series: at (the middle of the first and last time), value, count."""
    lo, hi = F.floor(F.min(micros()) / 1000), F.floor(F.max(micros()) / 1000)
    row = points.agg(at_micros(F.floor((lo + hi) / 2) * 1000).alias("at"), aggregate(call.function, call.arg).alias(call.name), F.count(F.lit(1)).alias("count"))
    return row.where("count > 0")


def aligned(points: DataFrame) -> DataFrame:
    """The values of all series at each time: ts, values (map of series to value, the first arrival of repeats).
    Long form; `pivoted` gives a column a series for a known list."""
    one = points.groupBy("ts", "series_key").agg(F.min_by("value", "seq").alias("value"))
    return one.groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series_key", "value")))).alias("values"))


def pivoted(points: DataFrame, column: str, names: list[str]) -> DataFrame:
    """ts and a column for each of the names of `column`: the first arrival's value there, or null."""
    o = F.struct("seq")
    return points.groupBy("ts").pivot(column, names).agg(F.min_by("value", o))
