"""The registry of aggregate functions: name to Column over the canonical columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import micros

#: Functions that need the steps between neighbouring points first.
COUNTERS = ("rate", "increase", "irate", "idelta")
_ALIASES = {"mean": "avg", "std": "stddev", "var": "variance", "stdvar": "variance", "p50": "median", "count_values": "count_distinct"}


def canonical(name: str) -> tuple[str, float | None]:
    """(function, argument) of a name as users write it: `p95`, `percentile99`, `quantile0.9`, `mean`."""
    name = name.lower()
    if name in _ALIASES:
        return _ALIASES[name], None
    if m := re.fullmatch(r"(?:p|percentile)(\d+(?:\.\d+)?)", name):
        return "percentile", float(m[1])
    if m := re.fullmatch(r"quantile(\d*\.?\d+)", name):
        return "percentile", 100 * float(m[1])
    return name, None


def order(ts: str = "ts", seq: str = "seq") -> Column:
    return F.struct(ts, seq)


def first(value: str = "value") -> Column:
    """The value of the earliest point, the earliest arrival of ties."""
    return F.min_by(value, order())


def last(value: str = "value") -> Column:
    return F.max_by(value, order())


def seconds() -> Column:
    """From the first to the last point."""
    return (F.max(micros()) - F.min(micros())) / 1e6


def nearest_rank(p: float, value: str = "value") -> Column:
    """The value at index round(p/100 (n-1)) of the sorted values."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.floor(F.lit(p / 100.0) * (F.size(ordered) - 1) + 0.5).cast("int"))


def floor_rank(p: float, value: str = "value") -> Column:
    """The value at index floor(p/100 (n-1)); null for p outside 0..100."""
    if not 0 <= p <= 100:
        return F.lit(None).cast("double")
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.floor(F.lit(p / 100.0) * (F.size(ordered) - 1)).cast("int"))


def aggregate(name: str, arg: float | None = None, value: str = "value", step: str = "step") -> Column:
    """The aggregate of a group. Sample variance and deviation of fewer than two points are 0. increase and rate
    sum the column `step` (see operators.counters); rate divides by the seconds from first to last point and is
    null where there are none. percentile takes 0..100 and interpolates. ValueError for an unknown name."""
    name, own = canonical(name)
    arg = own if arg is None else arg
    v = F.col(value)
    if name == "percentile" and (arg is None or not 0 <= arg <= 100):
        raise ValueError("percentile needs a number from 0 to 100")
    if name == "quantile" and (arg is None or not 0 <= arg <= 1):
        raise ValueError("quantile needs a number from 0 to 1")
    known = {
        "count": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "avg": lambda: F.avg(v),
        "stddev": lambda: F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.stddev_samp(v)),
        "variance": lambda: F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.var_samp(v)),
        "median": lambda: F.percentile(v, F.lit(0.5)),
        "percentile": lambda: F.percentile(v, F.lit(arg / 100.0)),
        "quantile": lambda: F.percentile(v, F.lit(float(arg))),
        "percentile_approx": lambda: F.percentile_approx(v, F.lit((95.0 if arg is None else arg) / 100.0), F.lit(10_000)),
        "first": lambda: first(value),
        "last": lambda: last(value),
        "delta": lambda: last(value) - first(value),
        "count_distinct": lambda: F.countDistinct(v),
        "count_distinct_approx": lambda: F.approx_count_distinct(v),
        "increase": lambda: F.greatest(F.coalesce(F.sum(step), F.lit(0.0)), F.lit(0.0)),
        "rate": lambda: F.when(seconds() > 0, F.greatest(F.coalesce(F.sum(step), F.lit(0.0)), F.lit(0.0)) / seconds()),
        "irate": lambda: F.max_by(F.col(step) / F.nullif(F.col("gap_s"), F.lit(0.0)), order()),
        "idelta": lambda: F.max_by("jump", order()),
        "absent": lambda: F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(0.0),
        "present": lambda: F.coalesce(F.max(v.isNotNull()), F.lit(False)),
    }
    if name not in known:
        raise ValueError(f"unknown aggregate function: {name!r}")
    return known[name]()
