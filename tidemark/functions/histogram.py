"""Quantiles of cumulative histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def histogram_quantile(q: float, buckets: Column) -> Column:
    """Of an array of (le double, count double) structs, cumulative, ending in the total: interpolated within
    the first bucket that reaches q times the total, from the bound before it (0 for the first). An infinite
    bucket gives the bound before it. Null for q outside 0..1, no buckets or a total of 0."""
    if not 0 <= q <= 1:
        return F.lit(None).cast("double")
    ordered = F.array_sort(buckets)
    total = F.element_at(ordered, -1)["count"]
    target = F.lit(float(q)) * total
    start = F.struct(F.lit(0.0).alias("bound"), F.lit(0.0).alias("count"), F.lit(None).cast("double").alias("answer"))

    def step(acc: Column, b: Column) -> Column:
        share = F.when(b["count"] > acc["count"], (target - acc["count"]) / (b["count"] - acc["count"])).otherwise(0.0)
        here = F.when(b["le"] == float("inf"), acc["bound"]).otherwise(acc["bound"] + (b["le"] - acc["bound"]) * share)
        return F.struct(b["le"].alias("bound"), b["count"].alias("count"), F.when(acc["answer"].isNull() & (b["count"] >= target), here).otherwise(acc["answer"]).alias("answer"))

    found = F.aggregate(ordered, start, step, lambda acc: F.coalesce(acc["answer"], acc["bound"]))
    return F.when((F.size(buckets) > 0) & (total != 0), found)
