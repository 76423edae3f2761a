"""The series behind the points: registration, search, families, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selectors


def series(points: DataFrame) -> DataFrame:
    """A row per series: series_key, metric, tags, created_at (first time), last_at, points."""
    rows = points.groupBy("series_key").agg(F.first("metric").alias("metric"), F.first(F.map_entries("tags")).alias("e"), F.min("ts").alias("created_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("points"))
    return rows.select("series_key", "metric", F.map_from_entries("e").alias("tags"), "created_at", "last_at", "points")


def register(known: DataFrame, new: DataFrame) -> DataFrame:
    """Both catalogues as one; a series that both hold keeps its earlier creation and later end."""
    both = known.unionByName(new)
    rows = both.groupBy("series_key").agg(F.first("metric").alias("metric"), F.first(F.map_entries("tags")).alias("e"), F.min("created_at").alias("created_at"), F.max("last_at").alias("last_at"), F.sum("points").alias("points"))
    return rows.select("series_key", "metric", F.map_from_entries("e").alias("tags"), "created_at", "last_at", "points")


def find(catalogue: DataFrame, metric: str | None = None, where: Column | None = None, prefix: str = "", pattern: str = "", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Series by metric, tag condition, metric prefix (`*` is any) and tag pattern, in order of their keys."""
    rows = catalogue
    if metric is not None:
        rows = rows.where(F.col("metric") == metric)
    if prefix.rstrip("*"):
        rows = rows.where(F.col("metric").startswith(prefix.rstrip("*")))
    if pattern:
        rows = rows.where(selectors.tag_pattern(F.col("tags"), pattern))
    rows = (rows if where is None else rows.where(where)).orderBy("series_key")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def of_series(points: DataFrame, found: DataFrame) -> DataFrame:
    """The points of the found series."""
    return points.join(found.select("series_key"), "series_key", "left_semi")


def families(catalogue: DataFrame) -> DataFrame:
    """metric, cardinality, tag_keys."""
    keys = catalogue.select("metric", F.explode_outer(F.map_keys("tags")).alias("k")).groupBy("metric").agg(F.array_sort(F.collect_set("k")).alias("tag_keys"))
    return catalogue.groupBy("metric").agg(F.count(F.lit(1)).alias("cardinality")).join(keys, "metric")


def merged_tags(catalogue: DataFrame) -> DataFrame:
    """tag, value (where all series that were given agree and have it, else null), varying, n_values, n_series."""
    total = catalogue.agg(F.count(F.lit(1)).alias("total"))
    tags = catalogue.select(F.explode(F.map_entries("tags")).alias("e")).groupBy(F.col("e.key").alias("tag")).agg(F.countDistinct("e.value").alias("n_values"), F.count(F.lit(1)).alias("n_series"), F.min("e.value").alias("least"))
    same = (F.col("n_values") == 1) & (F.col("n_series") == F.col("total"))
    return tags.crossJoin(F.broadcast(total)).select("tag", F.when(same, F.col("least")).alias("value"), (~same).alias("varying"), "n_values", "n_series")  # one row
