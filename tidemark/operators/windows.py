"""Time buckets: tumbling from the range's start, sliding, session, data-aligned; and gap filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import COUNTERS, aggregate, canonical
from ..model import at_micros, micros
from ..plans import ast
from . import counters

#: Cells or buckets of a group that one task steps through.
SLICE = 1 << 16


def tumbling(interval_ms: int, start_ms: int, ts: str = "ts") -> Column:
    """The start of the point's bucket; buckets count from start_ms."""
    us, origin = interval_ms * 1000, start_ms * 1000
    return at_micros(F.lit(origin) + F.floor((micros(ts) - origin) / us) * us)


def aggregates(points: DataFrame, calls: tuple[ast.Call, ...], keys: list[str], step_keys: list[str] | None = None) -> DataFrame:
    """The calls by keys, under their names. Counter functions step within each series of a group."""
    if any(canonical(c.function)[0] in COUNTERS for c in calls):
        points = counters.with_steps(points, *dict.fromkeys([*(step_keys if step_keys is not None else keys), "series_key"]))
    columns = [aggregate(c.function, c.arg).alias(c.name) for c in calls]
    return points.groupBy(*keys).agg(*columns) if keys else points.agg(*columns)


def sliding(points: DataFrame, calls: tuple[ast.Call, ...], size_ms: int, slide_ms: int, start_ms: int, keys: list[str]) -> DataFrame:
    """Windows of size_ms from every multiple of slide_ms after start_ms, each point in all that hold it; windows
    that would begin before start_ms are left out. Column `bucket` is the window's start."""
    slide, origin = slide_ms * 1000, start_ms * 1000
    last = F.floor((micros() - origin) / slide)
    first = F.greatest(F.floor((micros() - origin - size_ms * 1000) / slide) + 1, F.lit(0))
    spread = points.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    return aggregates(spread.withColumn("bucket", at_micros(F.lit(origin) + F.col("k") * slide)), calls, [*keys, "bucket"])


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, on equal keys, nulls included."""
    named = right.select(*[F.col(f"`{k}`").alias(f"__on{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    on = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"__on{i}")) for i, k in enumerate(keys)])
    return left.join(named, on, how).drop(*[f"__on{i}" for i in range(len(keys))])


def sessions(points: DataFrame, calls: tuple[ast.Call, ...], gap_ms: int, keys: list[str]) -> DataFrame:
    """Runs of points less than gap_ms apart; `bucket` is the first point's time, `bucket_end` the last's plus the gap.

    Points of one cell of gap_ms are in one session, so cells, a row each, tell where sessions start; starts are
    carried over slices of cells. No group's points are ever sorted, or in one task because there are no keys."""
    gap = gap_ms * 1000
    rows = points.withColumn("__cell", F.floor(micros() / gap))
    cells = rows.groupBy(*keys, "__cell").agg(F.min(micros()).alias("__lo"), F.max(micros()).alias("__hi"))
    before = cells.select(*keys, (F.col("__cell") + 1).alias("__cell"), F.col("__hi").alias("__before"))
    new = F.coalesce(F.col("__lo") - F.col("__before") >= gap, F.lit(True))
    starts = _joined(cells, before, [*keys, "__cell"], "left").select(*keys, "__cell", F.floor(F.col("__cell") / SLICE).alias("__slice"), F.when(new, F.col("__lo")).alias("__new"))
    inner = F.max("__new").over(Window.partitionBy(*keys, "__slice").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))
    slices = starts.groupBy(*keys, "__slice").agg(F.max("__new").alias("__last"))
    handed = F.max("__last").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = slices.select(*keys, "__slice", handed.alias("__handed"))
    found = _joined(starts.withColumn("__inner", inner), carried, [*keys, "__slice"]).select(*keys, "__cell", F.coalesce("__inner", "__handed").alias("__start"))
    placed = _joined(rows, found, [*keys, "__cell"])
    out = placed.groupBy(*keys, "__start").agg(F.max(micros()).alias("__end"), *[aggregate(c.function, c.arg).alias(c.name) for c in calls])
    return out.select(*keys, at_micros(F.col("__start")).alias("bucket"), at_micros(F.col("__end") + gap).alias("bucket_end"), *[c.name for c in calls])


def data_aligned(points: DataFrame, calls: tuple[ast.Call, ...], size_ms: int, step_ms: int | None = None) -> DataFrame:
    """Windows from the first point's time, rounded down to size_ms, every step_ms while they begin by the last
    point. Each is stamped with the middle of its part up to 1 ms after the last point: bucket, at, calls."""
    step_ms = step_ms or size_ms
    ends = points.agg(F.min(micros()).alias("lo"), F.max(micros()).alias("hi"))
    size, step = size_ms * 1000, step_ms * 1000
    joined = points.crossJoin(F.broadcast(ends)).withColumn("origin", F.floor(F.col("lo") / size) * size)  # one row
    last = F.floor((micros() - F.col("origin")) / step)
    first = F.greatest(F.floor((micros() - F.col("origin") - size) / step) + 1, F.lit(0))
    spread = joined.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    spread = spread.withColumn("lo_us", F.col("origin") + F.col("k") * step).withColumn("hi_us", F.least(F.col("lo_us") + size, F.floor(F.col("hi") / 1000) * 1000 + 1000))
    rows = aggregates(spread, calls, ["lo_us", "hi_us"])
    return rows.select(at_micros(F.col("lo_us")).alias("bucket"), at_micros(F.floor((F.floor(F.col("lo_us") / 1000) + F.floor(F.col("hi_us") / 1000)) / 2) * 1000).alias("at"), *[c.name for c in calls])


def fill(rows: DataFrame, fill: ast.Fill, names: list[str], keys: list[str], interval_ms: int, start_ms: int, end_ms: int) -> DataFrame:
    """Every bucket from start_ms to end_ms for every group of rows(keys, bucket, names): missing ones are null,
    0, a value, the last before, or on the line between their neighbours (null outside)."""
    if fill.kind == "none":
        return rows
    n = max(0, (end_ms - start_ms) // interval_ms)
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n // SLICE).cast("long"))).alias("__slice")
    groups = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    first = F.col("__slice") * SLICE
    grid = groups.select(*keys, slices).select(*keys, "__slice", F.explode(F.sequence(first, F.least(first + SLICE - 1, F.lit(n)))).alias("__k"))
    grid = grid.withColumn("bucket", at_micros(F.lit(start_ms * 1000) + F.col("__k") * (interval_ms * 1000)))
    full = _joined(grid, rows.select(*keys, "bucket", *names), [*keys, "bucket"], "left")
    if fill.kind == "null":
        return full.select(*keys, "bucket", *names)
    if fill.kind in ("zero", "value"):
        x = 0.0 if fill.kind == "zero" else float(fill.value)
        return full.select(*keys, "bucket", *[F.coalesce(c, F.lit(x)).alias(c) for c in names])
    if fill.kind not in ("previous", "linear"):
        raise ValueError(f"unknown fill: {fill.kind!r}")
    sides = (False, True) if fill.kind == "linear" else (False,)
    for ahead in sides:
        full = _with_neighbours(full, names, keys, ahead, n >= SLICE)
    out = []
    for c in names:
        back = F.col(f"__back_{c}")
        if fill.kind == "previous":
            out.append(back["v"].alias(c))
        else:
            ahead = F.col(f"__ahead_{c}")
            line = back["v"] + (ahead["v"] - back["v"]) * (F.col("__k") - back["k"]) / (ahead["k"] - back["k"])
            out.append(F.coalesce(F.col(c), line).alias(c))
    return full.select(*keys, "bucket", *out)


def _with_neighbours(full: DataFrame, names: list[str], keys: list[str], ahead: bool, sliced: bool) -> DataFrame:
    """full with __back_<name> or __ahead_<name>: struct<k, v> of the nearest bucket, itself included, that has a value.
    Windows run within slices; what a slice hands on is a row, so a group without keys is no single task."""
    order = F.desc if ahead else F.asc
    side = "__ahead_" if ahead else "__back_"
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("__k").alias("k"), F.col(c).alias("v"))) for c in names}
    w = Window.partitionBy(*keys, "__slice").orderBy(order("__k")).rowsBetween(Window.unboundedPreceding, 0)
    near = full.withColumns({side + c: F.last(known[c], ignorenulls=True).over(w) for c in names})
    if not sliced:
        return near
    edge = full.groupBy(*keys, "__slice").agg(*[(F.min if ahead else F.max)(known[c]).alias(c) for c in names])
    on = Window.partitionBy(*keys).orderBy(order("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    handed = edge.select(*keys, "__slice", *[F.last(c, ignorenulls=True).over(on).alias(f"__edge_{c}") for c in names])
    joined = _joined(near, handed, [*keys, "__slice"])
    return joined.withColumns({side + c: F.coalesce(side + c, f"__edge_{c}") for c in names}).drop(*[f"__edge_{c}" for c in names])
