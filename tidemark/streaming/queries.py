"""Queries of either language and of the builder over streams of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..model import literal_ts
from ..operators import grouping
from ..plans import ast, compiler
from ..plans.lexer import QueryError
from . import tail


def run(q: ast.Query, live: DataFrame, lateness: str = tail.LATENESS) -> DataFrame:
    """A stream with the query's columns. Selections give points as they come; aggregates by windows give a row once
    the watermark has passed the window. What needs all points at once (order, limit, latest, top, downsampling,
    filling, aggregates without windows, counters) is an error."""
    if q.order or q.limit is not None or q.offset or q.kind not in ("select", "aggregate"):
        raise QueryError("a stream has no order, limit, latest, top or downsampling")
    rows = tail.tail(live, q.metric, q.where).where((F.col("ts") >= literal_ts(q.start_ms)) & (F.col("ts") <= literal_ts(q.end_ms)))
    if q.kind == "select":
        return compiler._select(q, rows, ordered=False)
    if q.window is None or q.fill.kind != "none" or any(c.function in ("rate", "increase", "irate", "idelta") for c in q.calls):
        raise QueryError("a stream is aggregated by windows, without filling or counters")
    keys = list(q.group_by)
    rows = tail._timed(rows.select("*", *grouping.tag_columns(q.group_by)) if keys else rows, lateness)
    size = compiler.interval(q)
    if q.window.session:
        w = F.session_window("ts", f"{size} milliseconds")
    else:
        step = q.window.slide_ms or size
        origin = (q.start_ms + q.window.offset_ms) % step
        w = F.window("ts", f"{size} milliseconds", f"{step} milliseconds", f"{origin} milliseconds")
    # The metric, of which there is one, is a key because Spark has no sessions without keys in streams.
    out = rows.groupBy("metric", *keys, w.alias("w")).agg(*[aggregate(c.function, c.arg).alias(c.name) for c in q.calls])
    ends = [F.col("w.end").cast("timestamp_ntz").alias("bucket_end")] if q.window.session else []
    return out.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("bucket"), *ends, *[c.name for c in q.calls])
