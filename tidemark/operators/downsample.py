"""Downsampling of each series to about a target number of points. Series no longer than the target stay.

Buckets are of ceil(n / buckets) points in time order. The position of a point in its series comes from counts of
time slices plus its place in the slice, so no task sorts more than a slice of a long series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import at_micros, micros

LEAST_TARGET = 3
SLICE_US = 86_400_000_000
KEY = "series_key"


def numbered(points: DataFrame, key: str = KEY) -> DataFrame:
    """points with `pos`, the place in the series from 0, and `n`, the series' length."""
    rows = points.withColumn("slice", F.floor(micros() / SLICE_US))
    w = Window.partitionBy(key).orderBy("slice")
    sizes = rows.groupBy(key, "slice").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(key, "slice", (F.sum("size").over(w) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy(key)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key, "slice").orderBy("ts", "seq")) - 1
    return rows.withColumn("place", place).join(before, [key, "slice"]).withColumn("pos", F.col("before") + F.col("place")).drop("slice", "place", "before")


def _size(buckets: int) -> Column:
    return F.ceil(F.col("n") / F.lit(buckets))


def average(points: DataFrame, target: int, key: str = KEY) -> DataFrame:
    """key, ts, value: the mean time (whole milliseconds, rounded down) and value of each bucket."""
    target = max(LEAST_TARGET, target)
    rows = numbered(points, key).withColumn("b", F.when(F.col("n") <= target, F.col("pos")).otherwise(F.floor(F.col("pos") / _size(target))))
    ms = F.floor(micros() / 1000)
    out = rows.groupBy(key, "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.min("ts").alias("one"), F.sum(ms).alias("ms"), F.avg("value").alias("value"))
    ts = F.when(F.col("n") <= target, F.col("one")).otherwise(at_micros(F.floor(F.col("ms") / F.col("c")) * 1000))
    return out.select(key, ts.alias("ts"), "value")


def m4(points: DataFrame, target: int, key: str = KEY) -> DataFrame:
    """key, ts, value: the first, least, greatest and last point of each of target / 4 buckets, one of each time."""
    target = max(LEAST_TARGET, target)
    rows = numbered(points, key)
    small = rows.where(F.col("n") <= target).select(key, "pos", "ts", "value")
    p = F.struct("pos", "ts", "value")
    low, high = F.min_by(p, F.struct("value", "pos")), F.max_by(p, F.struct(F.col("value"), -F.col("pos")))
    of = rows.where(F.col("n") > target).withColumn("b", F.floor(F.col("pos") / _size(max(1, target // 4))))
    four = of.groupBy(key, "b").agg(F.array(F.min_by(p, "pos"), low, high, F.max_by(p, "pos")).alias("four"))
    spread = four.select(key, F.explode(F.array_distinct("four")).alias("p")).select(key, "p.*")
    one = spread.groupBy(key, "ts").agg(F.min(F.struct("pos", "value")).alias("p")).select(key, F.col("p.pos").alias("pos"), "ts", F.col("p.value").alias("value"))
    kept = one.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("rn") <= target).drop("rn")
    return small.unionByName(kept).select(key, "ts", "value")


def min_max(points: DataFrame, target: int, key: str = KEY) -> DataFrame:
    """key, ts, value: the least and the greatest point of each of target / 2 buckets."""
    target = max(LEAST_TARGET, target)
    rows = numbered(points, key)
    p = F.struct("pos", "ts", "value")
    of = rows.withColumn("b", F.when(F.col("n") <= target, F.col("pos")).otherwise(F.floor(F.col("pos") / _size(max(1, target // 2)))))
    two = of.groupBy(key, "b").agg(F.array_distinct(F.array(F.min_by(p, F.struct("value", "pos")), F.max_by(p, F.struct(F.col("value"), -F.col("pos"))))).alias("two"))
    return two.select(key, F.explode("two").alias("p")).select(key, "p.ts", "p.value")


def first(points: DataFrame, target: int, key: str = KEY) -> DataFrame:
    """The first point of each bucket: no aggregate, as its place tells."""
    target = max(LEAST_TARGET, target)
    return numbered(points, key).where((F.col("n") <= target) | (F.col("pos") % _size(target) == 0)).select(key, "ts", "value")


def last(points: DataFrame, target: int, key: str = KEY) -> DataFrame:
    target = max(LEAST_TARGET, target)
    end = (F.col("pos") % _size(target) == _size(target) - 1) | (F.col("pos") == F.col("n") - 1)
    return numbered(points, key).where((F.col("n") <= target) | end).select(key, "ts", "value")


def largest_triangles(t: np.ndarray, v: np.ndarray, target: int) -> np.ndarray:
    """Indices kept by largest-triangle-three-buckets: the first, the last and one of each bucket between."""
    n = len(t)
    if n <= target or target < 3:
        return np.arange(n)
    width = (n - 2) / (target - 2)
    edges = np.floor(np.arange(target + 1) * width).astype(int) + 1
    sums_t, sums_v = np.concatenate([[0.0], np.cumsum(t)]), np.concatenate([[0.0], np.cumsum(v)])
    kept = [0]
    for i in range(target - 2):
        a, b, c = edges[i], min(edges[i + 1], n - 1), min(edges[i + 2], n)
        mean_t, mean_v = ((sums_t[c] - sums_t[b]) / (c - b), (sums_v[c] - sums_v[b]) / (c - b)) if c > b else (t[-1], v[-1])
        p = kept[-1]
        area = np.abs((t[p] - mean_t) * (v[a:b] - v[p]) - (t[p] - t[a:b]) * (mean_v - v[p]))
        kept.append(a + int(area.argmax()) if b > a else a)
    return np.array([*kept, n - 1])


def lttb(points: DataFrame, target: int, key: str = KEY) -> DataFrame:
    """key, ts, value by largest triangles over every point. Each pick depends on the one before, so a series streams
    through one task in sorted batches; each row brings the mean of the next bucket, and only the last pick and the
    bucket's best point so far are kept, so its length doesn't count against memory."""
    target = max(LEAST_TARGET, target)
    import pandas as pd

    ms = F.floor(micros() / 1000)
    rows = numbered(points.where("value is not null").select(key, "ts", "seq", "value"), key)
    starts = rows.groupBy(key).agg(F.min(ms).alias("t0"))
    rows = rows.join(starts, key).withColumn("t", (ms - F.col("t0")).cast("double")).drop("t0")
    width = (F.col("n") - 2) / F.lit(target - 2)
    guess = F.floor((F.col("pos") - 1) / width)
    edge = lambda b: F.floor(b * width) + 1
    bucket = F.when(F.col("pos") < edge(guess), guess - 1).when(F.col("pos") >= edge(guess + 1), guess + 1).otherwise(guess)
    # The first point is bucket -1; the last is a bucket of its own, the one after the others.
    rows = rows.withColumn("b", F.when(F.col("n") <= target, F.lit(None)).when(F.col("pos") == 0, -1).when(F.col("pos") == F.col("n") - 1, target - 2).otherwise(F.least(bucket, F.lit(target - 3))).cast("long"))
    means = rows.where("b >= 1").groupBy(key, "b").agg(F.avg("t").alias("next_t"), F.avg("value").alias("next_v")).withColumn("b", F.col("b") - 1)
    ordered = rows.join(means, [key, "b"], "left").select(key, "ts", "pos", "value", "b", "t", "next_t", "next_v").repartition(key).sortWithinPartitions(key, "pos")

    def run(batches):
        last_key = bucket = best = pick = None  # best: (area, ts, t, value) of the bucket; pick: (t, value)
        for pdf in batches:
            out = []
            b, t, v, ts = pdf["b"].to_numpy(float), pdf["t"].to_numpy(float), pdf["value"].to_numpy(float), pdf["ts"].to_numpy()
            next_t, next_v, keys = pdf["next_t"].to_numpy(float), pdf["next_v"].to_numpy(float), pdf[key].to_numpy()
            new = np.ones(len(pdf), bool)
            new[1:] = (keys[1:] != keys[:-1]) | ((b[1:] != b[:-1]) | np.isnan(b[1:]))
            for lo, hi in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], len(pdf)], strict=True):
                if best is not None and (keys[lo] != last_key or b[lo] != bucket):
                    out.append((last_key, best[1], best[3]))
                    pick, best = best[2:], None
                last_key, bucket = keys[lo], b[lo]
                if np.isnan(bucket) or bucket in (-1, target - 2):
                    out.append((last_key, ts[lo], v[lo]))
                    pick = (t[lo], v[lo])
                    continue
                area = np.abs((pick[0] - next_t[lo]) * (v[lo:hi] - pick[1]) - (pick[0] - t[lo:hi]) * (next_v[lo] - pick[1]))
                at = lo + int(area.argmax())
                if best is None or area[at - lo] > best[0]:
                    best = (area[at - lo], ts[at], t[at], v[at])
            yield pd.DataFrame({key: [x[0] for x in out], "ts": np.array([x[1] for x in out], "datetime64[ns]"), "value": [float(x[2]) for x in out]})

    return ordered.mapInPandas(run, ordered.select(key, "ts", "value").schema)


METHODS = {"lttb": lttb, "m4": m4, "minmax": min_max, "average": average, "avg": average, "first": first, "last": last}


def downsample(points: DataFrame, method: str, target: int, key: str = KEY) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown downsampling method: {method!r}")
    return METHODS[method](points, target, key)
