"""Synthetic metrics for trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import at_micros, points

METRICS = ("cpu_usage", "memory_usage", "disk_io", "http_requests")


def metrics(spark: SparkSession, hosts: int, samples: int, step_ms: int = 10_000, start_ms: int = 1_700_000_000_000, seed: int = 7) -> DataFrame:
    """Points of four metrics for each host: a daily wave with noise; http_requests is a rising counter."""
    n = spark.range(hosts * samples * len(METRICS))
    k = F.col("id") % len(METRICS)
    host = (F.floor(F.col("id") / len(METRICS)) % hosts).cast("string")
    i = F.floor(F.col("id") / (len(METRICS) * hosts))
    ts = at_micros((F.lit(start_ms) + i * step_ms) * 1000)
    wave = 50 + 30 * F.sin(i * step_ms * F.lit(2 * 3.141592653589793 / 86_400_000)) + 5 * F.randn(seed)
    metric = F.element_at(F.array(*map(F.lit, METRICS)), (k + 1).cast("int"))
    return points(n, metric, F.create_map(F.lit("host"), F.concat(F.lit("host"), host)), ts, F.when(k == 3, i * 10.0).otherwise(wave), F.col("id"))
