"""Counter functions: increases with resets, rates, deltas of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import micros

#: Points of a series are stepped through in slices of this length, so that no task holds a whole long series.
SLICE_US = 86_400_000_000


def _ordered(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def step(value: Column, before: Column) -> Column:
    """What a counter grew by: a fall is a reset, after which it counts from 0."""
    return F.when(value < before, value).otherwise(value - before)


def with_steps(points: DataFrame, *keys: str) -> DataFrame:
    """The points that have a value, with `step` from the point before within the keys, `jump` (the plain
    difference) and `gap_s` (the seconds between); null for the first."""
    w = _ordered(*keys)
    before = F.lag("value").over(w)
    rows = points.where("value is not null").withColumn("before", before).withColumn("gap_s", (micros() - F.lag(micros()).over(w)) / 1e6)
    return rows.withColumns({"step": step(F.col("value"), F.col("before")), "jump": F.col("value") - F.col("before")}).drop("before")


def totals(points: DataFrame, key: str = "series_key", slice_us: int = SLICE_US) -> DataFrame:
    """A row per series: key, first_ts, last_ts, first_value, last_value, increase, n. Steps are summed within
    slices of time, and the slices, a row each, are joined up by the step over their edge."""
    rows = points.where("value is not null").withColumn("slice", F.floor(micros() / slice_us))
    stepped = with_steps(rows, key, "slice")
    o = F.struct("ts", "seq")
    part = stepped.groupBy(key, "slice").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("value", o).alias("first_value"), F.max_by("value", o).alias("last_value"), F.sum("step").alias("inner"), F.count(F.lit(1)).alias("n"))
    edge = step(F.col("first_value"), F.lag("last_value").over(Window.partitionBy(key).orderBy("slice")))
    joined = part.withColumn("edge", edge)
    return joined.groupBy(key).agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min_by("first_value", "slice").alias("first_value"),
        F.max_by("last_value", "slice").alias("last_value"),
        (F.coalesce(F.sum("inner"), F.lit(0.0)) + F.coalesce(F.sum("edge"), F.lit(0.0))).alias("increase"),
        F.sum("n").alias("n"),
    )


def rate(points: DataFrame, key: str = "series_key") -> DataFrame:
    """series_key, increase, rate (a second), delta: rate is null for fewer than two points or no time between."""
    t = totals(points, key)
    dt = (micros("last_ts") - micros("first_ts")) / 1e6
    return t.select(key, "increase", F.when((F.col("n") >= 2) & (dt > 0), F.col("increase") / dt).alias("rate"), (F.col("last_value") - F.col("first_value")).alias("delta"))


def last_two(points: DataFrame, key: str = "series_key") -> DataFrame:
    """series_key, irate, idelta from the last two points; series of one point are left out. The two
    latest are cut within tasks before the shuffle (a window with a rank limit), then sorted per series."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    two = points.where("value is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    wide = two.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", -F.col("rn")).alias("v1"), F.max_by("value", "rn").alias("v0"), F.max("ts").alias("t1"), F.min("ts").alias("t0")).where("n = 2")
    dt = (micros("t1") - micros("t0")) / 1e6
    return wide.select(key, F.when(dt > 0, step(F.col("v1"), F.col("v0")) / dt).alias("irate"), (F.col("v1") - F.col("v0")).alias("idelta"))


def pairwise_delta(points: DataFrame, key: str = "series_key") -> DataFrame:
    """Each point's value less the one before; the first of a series is left out."""
    d = points.withColumn("delta", F.col("value") - F.lag("value").over(_ordered(key)))
    return d.where("delta is not null").select(key, "ts", "seq", "delta")
