"""Stored files as chunks: listing by metric, series and range, tiers by age, and which small ones to merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import COLUMNS, literal_ts, micros
from ..sources import files

HOT_DAYS, WARM_DAYS = 7, 30
#: Rows that a merged chunk should have, the longest gap and span of one, and the least share of files that go.
TARGET_ROWS, MOST_GAP_MS, MOST_SPAN_MS, LEAST_GAIN = 1_000_000, 86_400_000, 7 * 86_400_000, 0.5
#: Files that one call of merge takes on; a further call goes on with the rest.
MOST_FILES = 10_000


def listing(spark: SparkSession, path: str, metric: str | None = None, series_key: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """chunk (its file), metric, day, rows, series, min_ts, max_ts, bytes of the files that hold points of the metric, series and range;
    the figures are of those points."""
    rows = files.read(spark, path, metric, start_ms, end_ms).select("*", F.col("_metadata.file_path").alias("chunk"), F.col("_metadata.file_size").alias("size"))
    if series_key is not None:
        rows = rows.where(F.col("series_key") == series_key)
    return rows.groupBy("chunk", "metric", "day").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("series_key").alias("series"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max("size").alias("bytes"))


def tier(ts: Column, now_ms: int, hot_days: int = HOT_DAYS, warm_days: int = WARM_DAYS) -> Column:
    """hot, warm or cold, by age."""
    age = lambda days: literal_ts(now_ms - days * 86_400_000)
    return F.when(ts >= age(hot_days), "hot").when(ts >= age(warm_days), "warm").otherwise("cold")


def merge_plan(chunks: DataFrame, target_rows: int = TARGET_ROWS, most_gap_ms: int = MOST_GAP_MS, most_span_ms: int = MOST_SPAN_MS, least_gain: float = LEAST_GAIN, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Which chunks to merge: by, merged (their names in order), n_chunks, rows, min_ts, max_ts.

    Of chunks (by, chunk, rows, min_ts, max_ts), those under target_rows are taken in order of time. A gap beyond
    most_gap_ms to all before it starts a new run; a run is cut where its rows or its span pass another multiple of
    the target or of most_span_ms. Groups whose merging saves less than least_gain of their files are left alone."""
    order = Window.partitionBy(*by).orderBy("min_ts", "chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    small = chunks.where(F.col("rows") < target_rows)
    apart = micros("min_ts") - micros(F.max("max_ts").over(before)) > most_gap_ms * 1000
    runs = small.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(so_far))
    in_run = Window.partitionBy(*by, "run").orderBy("min_ts", "chunk").rowsBetween(Window.unboundedPreceding, 0)
    full = F.floor((F.sum("rows").over(in_run) - 1) / target_rows)
    long = F.floor((micros("max_ts") - micros(F.first("min_ts").over(in_run))) / (most_span_ms * 1000))
    groups = runs.withColumns({"full": full, "long": long}).groupBy(*by, "run", "full", "long")
    found = groups.agg(F.array_sort(F.collect_list(F.struct("min_ts", "chunk"))).alias("c"), F.count(F.lit(1)).alias("n_chunks"), F.sum("rows").alias("rows"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    worth = (F.col("n_chunks") > 1) & (1 - 1 / F.col("n_chunks") >= least_gain)
    return found.where(worth).select(*by, F.col("c.chunk").alias("merged"), "n_chunks", "rows", "min_ts", "max_ts")


def merge(spark: SparkSession, path: str, dry_run: bool = False, most_files: int = MOST_FILES, **limits) -> DataFrame:
    """Merge the small files of each metric and day that merge_plan() chooses, and return the plan. The merged files
    are added before the old ones go, so a run that stops in between leaves points twice, which queries read once;
    files that aren't chosen aren't read. dry_run: only the plan."""
    plan = merge_plan(listing(spark, path), by=("metric", "day"), **limits)
    rows = plan.orderBy("metric", "day", "min_ts").limit(most_files).collect()
    plan = spark.createDataFrame(rows, plan.schema)
    old = [c for r in rows for c in r.merged]
    if dry_run or not old:
        return plan
    chosen = spark.createDataFrame([(c,) for c in old], "chunk string")
    points = files.read(spark, path).select("*", F.col("_metadata.file_path").alias("chunk")).join(F.broadcast(chosen), "chunk", "left_semi")  # at most most_files groups of names
    days = [(F.col("metric") == r.metric) & (F.col("day") == F.lit(r.day)) for r in rows]
    if len(days) <= 100:  # prunes the partitions that are read
        wanted = days[0]
        for d in days[1:]:
            wanted = wanted | d
        points = points.where(wanted)
    files.write(points.select(*COLUMNS), path, 1, "append")
    for c in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(c))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    spark.catalog.refreshByPath(path)
    return plan
