"""Retention, deletion, compaction and integrity of stored points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import literal_ts
from ..sources import files

RETENTION_DAYS = 30


def keep_since(points: DataFrame, now_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """The points that retention keeps: not older than `days` before now. A literal bound, so it is pushed down."""
    return points.where(F.col("ts") >= literal_ts(now_ms - days * 86_400_000))


def expired_days(spark: SparkSession, path: str, now_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """The day partitions that end before the cutoff."""
    edge = F.to_date(literal_ts(now_ms - days * 86_400_000))
    return files.read(spark, path).where(F.col("day") < edge).select("metric", "day").distinct()


def apply_retention(spark: SparkSession, path: str, to: str, now_ms: int, days: int = RETENTION_DAYS) -> None:
    """Write what is kept to a new place. Whole expired days aren't read."""
    edge = F.to_date(literal_ts(now_ms - days * 86_400_000))
    files.write(keep_since(files.read(spark, path).where(F.col("day") >= edge), now_ms, days), to)


def delete_series(points: DataFrame, condition: Column) -> DataFrame:
    """The points that stay when the series that fit the condition go."""
    return points.where(~F.coalesce(condition, F.lit(False)))


def compact(spark: SparkSession, path: str, to: str, files_a_day: int | None = None) -> None:
    """Rewrite all, sorted by series and time, as files.write() parts it; chunks.merge() rewrites only small files."""
    files.write(files.read(spark, path), to, files_a_day)


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, min_ts, max_ts, min_value, max_value, series: what each file holds."""
    rows = files.read(spark, path).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.countDistinct("series_key").alias("series"))


def integrity(points: DataFrame) -> DataFrame:
    """problem, n: rows that break a rule of the stored form."""
    checks = {
        "no series": F.col("series_key").isNull(),
        "no time": F.col("ts").isNull(),
        "no value": F.col("value").isNull(),
        "key differs from metric": ~F.col("series_key").startswith(F.col("metric")),
    }
    counted = points.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in checks.items()])
    return counted.unpivot([], list(checks), "problem", "n").where("n > 0")
