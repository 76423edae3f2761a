"""Stored points: Parquet by metric and day, sorted by series and time, with a Bloom filter on the series key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLUMNS, literal_ts

SCHEMA = "series_key string, tags map<string,string>, ts timestamp_ntz, value double, seq long, metric string, day date"


def write(points: DataFrame, path: str, files_a_day: int | None = None, mode: str = "errorifexists", most_rows: int = 0) -> None:
    """Partitions metric and day. By default a metric's day is a file, and where it is large adaptive execution parts it
    among tasks by size; `files_a_day` spreads it, by series, over so many. most_rows (0: any) ends a file early."""
    rows = points.select(*COLUMNS, F.to_date("ts").alias("day"))
    if files_a_day is None:
        placed = rows.hint("rebalance", F.col("metric"), F.col("day")).sortWithinPartitions("metric", "day", "series_key", "ts")
    else:
        spread = F.pmod(F.xxhash64("series_key"), F.lit(files_a_day))
        placed = rows.withColumn("__s", spread).repartition("metric", "day", "__s").sortWithinPartitions("metric", "day", "series_key", "ts").drop("__s")
    options = {"compression": "zstd", "parquet.bloom.filter.enabled#series_key": "true", "maxRecordsPerFile": most_rows}
    placed.write.options(**options).partitionBy("metric", "day").mode(mode).parquet(path)


def read(spark: SparkSession, path: str, metric: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Points with `day`. A metric and time bounds prune partitions and row groups."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if metric is not None:
        rows = rows.where(F.col("metric") == metric)
    if start_ms is not None:
        rows = rows.where((F.col("ts") >= literal_ts(start_ms)) & (F.col("day") >= F.to_date(literal_ts(start_ms))))
    if end_ms is not None:
        rows = rows.where((F.col("ts") <= literal_ts(end_ms)) & (F.col("day") <= F.to_date(literal_ts(end_ms))))
    return rows
