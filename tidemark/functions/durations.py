"""Durations and automatic bucket sizes; plain Python, evaluated while planning."""

from __future__ import annotations

import re

# Milliseconds of each unit.
UNITS = {"ns": 1e-6, "us": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6, "d": 8.64e7, "w": 6.048e8, "y": 3.1536e10}
# The bucket sizes that "auto" chooses from.
STANDARD = ("1s", "10s", "30s", "1m", "5m", "15m", "30m", "1h", "6h", "12h", "1d")
AUTO_POINTS, MOST_POINTS, LEAST_POINTS = 200, 300, 10
_DURATION = re.compile(r"(\d+)(ns|us|ms|s|m|h|d|w|y)")


def parse(text: str) -> int:
    """Milliseconds of `5m` and the like, rounded down; ValueError for anything else."""
    m = _DURATION.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(int(m[1]) * UNITS[m[2]])


def show(ms: int) -> str:
    """The shortest whole form: 60000 is 1m."""
    for unit in ("w", "d", "h", "m", "s"):
        if ms and ms % UNITS[unit] == 0:
            return f"{int(ms // UNITS[unit])}{unit}"
    return f"{ms}ms"


def auto(range_ms: int, points: int = AUTO_POINTS) -> int:
    """The standard size nearest to range / points, the smaller of two as near; a minute for an empty range."""
    if range_ms <= 0 or points <= 0:
        return parse("1m")
    ideal = range_ms // points
    return min((parse(x) for x in STANDARD), key=lambda x: abs(x - ideal))


def warning(interval_ms: int, range_ms: int) -> str | None:
    """What to say of an interval that gives very many or very few buckets."""
    if interval_ms <= 0 or range_ms <= 0:
        return None
    n = range_ms // interval_ms
    if n > MOST_POINTS:
        return f"about {n} buckets: slow to draw; use a larger interval or auto"
    if n < LEAST_POINTS:
        return f"only about {n} buckets: little detail; use a smaller interval or auto"
    return None
