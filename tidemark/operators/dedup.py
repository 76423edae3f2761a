"""One point for each series and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup(points: DataFrame, keep: str = "first", order: Column | None = None) -> DataFrame:
    """The first or last arrival of the points of a series at one time, by `order` (default seq). A partial
    aggregate: no sort, and a series with very many points is spread over tasks by time."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    if order is None:
        return _by_arrival(points, keep)
    o = order
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in points.columns if c not in ("series_key", "ts")]
    row = points.groupBy("series_key", "ts").agg(pick(F.struct(*rest), o).alias("row"))
    return row.select("series_key", "ts", "row.*").select(*points.columns)


def _by_arrival(points: DataFrame, keep: str) -> DataFrame:
    """Column by column, so that columns nobody asks for aren't shuffled."""
    pick, edge = (F.min_by, F.min) if keep == "first" else (F.max_by, F.max)
    keys = [c for c in ("series_key", "metric", "ts", "day") if c in points.columns]
    picked = {c: pick(c, "seq") for c in points.columns if c not in keys} | {"seq": edge("seq")}
    return points.groupBy(*keys).agg(*[v.alias(c) for c, v in picked.items()]).select(*points.columns)
