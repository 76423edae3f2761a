"""JSON payloads: an object or an array of `{"measurement", "tags", "fields", "timestamp"}`.

Numbers become integers, unsigned ones or floats; other values text, nested ones as JSON text."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame

from . import line, parsed

MOST_POINTS = 100_000


def _field(x) -> dict:
    if isinstance(x, bool):
        return parsed.field("b", x)
    if isinstance(x, int):
        if -(1 << 63) <= x < 1 << 63:
            return parsed.field("i", x)
        return parsed.field("u", Decimal(x)) if 0 <= x < 1 << 64 else parsed.field("f", float(x))
    if isinstance(x, float):
        return parsed.field("f", x)
    return parsed.field("s", x if isinstance(x, str) else json.dumps(x))


def _point(x, default: str | None) -> dict:
    if not isinstance(x, dict):
        raise ValueError("a point must be an object")
    name = x.get("measurement") or default
    if not name or not isinstance(name, str):
        raise ValueError("measurement is missing")
    fields = x.get("fields")
    if not isinstance(fields, dict) or not fields:
        raise ValueError("fields are missing")
    tags, ts = x.get("tags") or {}, x.get("timestamp")
    if not isinstance(tags, dict) or ts is not None and (isinstance(ts, bool) or not isinstance(ts, int) or not -(1 << 63) <= ts < 1 << 63):
        raise ValueError("bad tags or timestamp")
    text = {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in tags.items()}
    return {"measurement": name, "tags": text, "fields": {k: _field(v) for k, v in fields.items() if v is not None}, "ts_ns": ts, "error": None}


def parse(text: str, default: str | None = None, most: int = MOST_POINTS) -> list[dict]:
    """The payload's points; ValueError says what is wrong with it."""

    def refuse(name: str):
        raise ValueError(f"{name} isn't JSON")

    data = json.loads(text, parse_constant=refuse)
    every = data if isinstance(data, list) else [data]
    if len(every) > most:
        raise ValueError(f"more than {most} points")
    return [_point(x, default) for x in every]


def rows(payloads: DataFrame, column: str = "value", seq: str | None = None) -> DataFrame:
    """parsed rows; a bad payload gives one row with its error."""
    return line.scanned(line.numbered(payloads, column, seq), parse)
