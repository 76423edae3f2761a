"""Queries to DataFrames: the only executor.

Time bounds and the metric are plain literals on plain columns, so they reach the scan; the rest is left to Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import durations
from ..functions.aggregates import canonical
from ..model import literal_ts
from ..operators import counters, dedup, downsample, grouping, selectors, topk, windows
from . import ast
from .lexer import QueryError

_COLUMNS = {"time": "ts", "timestamp": "ts", "ts": "ts", "value": "value", "series": "series_key", "series_key": "series_key", "metric": "metric", "tags": "tags"}
STAR = ("series_key", "ts", "value")


def _of_series(condition: ast.Condition) -> bool:
    """Whether the condition looks at tags alone, so that it holds for all points of a series or none."""
    if isinstance(condition, (ast.And, ast.Or)):
        return all(map(_of_series, condition.parts))
    return _of_series(condition.part) if isinstance(condition, ast.Not) else isinstance(condition, ast.TagMatcher)


def scan(q: ast.Query, points: DataFrame, keep: str | None = None) -> DataFrame:
    """The points that the query's metric, time range and conditions leave. keep first or last: of points of a series
    at one time only that arrival is there, for conditions on values too; those on tags go before, to the scan."""
    rows = points.where((F.col("metric") == q.metric) & (F.col("ts") >= literal_ts(q.start_ms)) & (F.col("ts") <= literal_ts(q.end_ms)))
    if "day" in points.columns:
        rows = rows.where((F.col("day") >= F.to_date(literal_ts(q.start_ms))) & (F.col("day") <= F.to_date(literal_ts(q.end_ms))))
    parts = q.where.parts if isinstance(q.where, ast.And) else () if q.where is None else (q.where,)
    for p in parts:
        if keep is None or _of_series(p):
            rows = rows.where(selectors.condition(p))
    if keep is not None:
        rows = dedup.dedup(rows, keep)
        for p in parts:
            if not _of_series(p):
                rows = rows.where(selectors.condition(p))
    return rows


def interval(q: ast.Query) -> int:
    """The bucket size: given, or chosen from the range."""
    return q.window.interval_ms or durations.auto(q.end_ms - q.start_ms)


def compile(q: ast.Query, points: DataFrame, keep: str | None = None) -> DataFrame:
    """The query's result over points, of which keep (first, last) leaves one for each series and time.

    select: the columns (series_key, ts, value for `*`), by time. aggregate: the tags grouped by, `bucket` if
    there are windows, and a column per call; counters without a bucket are summed over the series. downsample: series_key,
    ts, value. latest: the newest points, oldest first. top: series_key, value of the last point of each series.
    """
    rows = scan(q, points, keep)
    if q.kind == "select":
        return _select(q, rows)
    if q.kind == "aggregate":
        return _aggregate(q, rows)
    if q.kind == "downsample":
        out = downsample.downsample(rows, q.method, q.target)
        return topk.page(topk.sort(out, q.order or (("time", False),)), q.limit, q.offset)
    if q.kind == "latest":
        return topk.latest(rows, q.limit or 1).select(*STAR)
    if q.kind == "top":
        last = rows.where("value is not null").groupBy("series_key").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
        return topk.top(last, q.limit, largest=q.order[0][1])
    raise QueryError(f"unknown kind of query: {q.kind!r}")


def _select(q: ast.Query, rows: DataFrame, ordered: bool = True) -> DataFrame:
    names: list[str] = []
    for c in q.columns:
        names += STAR if c == "*" else (_COLUMNS.get(c.lower(), f"tag:{c}"),)
    if ordered:
        rows = topk.page(topk.sort(rows, q.order or (("time", False),)), q.limit, q.offset)
    return rows.select(*[F.col("tags")[n[4:]].alias(n[4:]) if n.startswith("tag:") else F.col(n) for n in dict.fromkeys(names)])


def _aggregate(q: ast.Query, rows: DataFrame) -> DataFrame:
    keys = list(q.group_by)
    names = [c.name for c in q.calls]
    if keys:
        rows = rows.select("*", *grouping.tag_columns(q.group_by))
    elif any(canonical(c.function)[0] in ("irate", "idelta") for c in q.calls):
        keys = ["series_key"]  # steps of different series don't make one
    if q.window is None:
        if {canonical(c.function)[0] for c in q.calls} <= {"rate", "increase"}:
            out = _counters(q, rows, keys)
        else:
            out = windows.aggregates(rows, q.calls, keys)
        order = [("value", d) if f == "value" and "value" in names else (f, d) for f, d in q.order if f in names or f in keys]
        return topk.page(topk.sort(out, tuple(order), tuple(keys)) if keys else out, q.limit, q.offset)
    size, start = interval(q), q.start_ms + q.window.offset_ms
    if q.window.session:
        out = windows.sessions(rows, q.calls, size, keys)
    elif q.window.slide_ms:
        out = windows.sliding(rows, q.calls, size, q.window.slide_ms, start, keys)
    else:
        out = windows.aggregates(rows.withColumn("bucket", windows.tumbling(size, start)), q.calls, [*keys, "bucket"])
        out = windows.fill(out, q.fill, names, keys, size, start, q.end_ms)
    order = tuple(("bucket" if f in ("time", "ts", "timestamp") else f, d) for f, d in q.order) or (("bucket", False),)
    if any(f == "value" for f, _ in order) and len(names) == 1:
        order = tuple((names[0] if f == "value" else f, d) for f, d in order)
    return topk.page(topk.sort(out, order, ("bucket", *keys)), q.limit, q.offset)


def _counters(q: ast.Query, rows: DataFrame, keys: list[str]) -> DataFrame:
    """increase and rate of whole ranges: per series in slices, then summed by the keys; rate divides by the time
    from the group's first to its last point."""
    per = counters.totals(rows)
    if keys:
        per = per.join(rows.groupBy("series_key").agg(*[F.first(k).alias(k) for k in keys]), "series_key")
    grow = F.coalesce(F.sum("increase"), F.lit(0.0))
    dt = (F.unix_micros(F.max("last_ts").cast("timestamp")) - F.unix_micros(F.min("first_ts").cast("timestamp"))) / 1e6
    columns = [(grow if canonical(c.function)[0] == "increase" else F.when(dt > 0, grow / dt)).alias(c.name) for c in q.calls]
    return per.groupBy(*keys).agg(*columns) if keys else per.agg(*columns)
