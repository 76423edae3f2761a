"""Moving windows over the points of a series, by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000
FUNCTIONS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def moving(points: DataFrame, function: str, size: int, key: str = "series_key") -> DataFrame:
    """points with `moving`: avg, sum, min or max of the last `size` points, fewer at the start."""
    if not 1 <= size <= MOST_ROWS:
        raise ValueError(f"window size must be 1 to {MOST_ROWS}")
    w = Window.partitionBy(key).orderBy("ts", "seq").rowsBetween(-(size - 1), 0)
    return points.withColumn("moving", FUNCTIONS[function]("value").over(w))


def exponential_moving_avg(points: DataFrame, alpha: float, key: str = "series_key") -> DataFrame:
    """series_key, ts, seq, ema: alpha (held to 0..1) of the value, the rest of the average so far, seeded with
    the first. The recurrence is sequential: a series streams through one task in sorted batches, and only the
    running average is kept, so its length doesn't count against memory."""
    import pandas as pd

    a = min(1.0, max(0.0, float(alpha)))

    def run(batches):
        last_key, average = None, None
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf["value"], strict=True):
                if k != last_key:
                    last_key, average = k, None
                if v == v and v is not None:
                    average = v if average is None else a * v + (1 - a) * average
                out.append(average)
            yield pd.DataFrame({key: pdf[key], "ts": pdf["ts"], "seq": pdf["seq"], "ema": pd.Series(out, dtype="float64", index=pdf.index)})

    ordered = points.select(key, "ts", "seq", "value").repartition(key).sortWithinPartitions(key, "ts", "seq")
    return ordered.mapInPandas(run, f"{key} string, ts timestamp_ntz, seq long, ema double")
