"""Protocol-buffer payloads, decoded and encoded by hand, as Spark's own reader needs a jar.

WriteRequest { repeated TimeSeries timeseries = 1; }
TimeSeries { string measurement = 1; repeated Label labels = 2; repeated Sample samples = 3; }
Label { string name = 1; string value = 2; }   Sample { int64 timestamp = 1; double value = 2; }
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parsed

VALUE_FIELD = "value"


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return -(n + 1 >> 1) if n & 1 else n >> 1


def _number(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            raise ValueError("cut short")
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n & (1 << 64) - 1, at
    raise ValueError("number too long")


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a message; groups are refused."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            if kind == 2:
                n, at = _number(data, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            if at + n > len(data):
                raise ValueError("cut short")
            value, at = data[at : at + n], at + n
        yield key >> 3, kind, value


def _need(ok: bool) -> None:
    if not ok:
        raise ValueError("unexpected wire type")


def decode(data: bytes) -> list[dict]:
    """Parsed rows, one per sample; a timestamp of 0 is missing."""
    out = []
    for number, kind, series in fields(data):
        if number != 1:
            continue
        _need(kind == 2)
        name, tags, samples = "", {}, []
        for n, k, v in fields(series):
            if n not in (1, 2, 3):
                continue
            _need(k == 2)
            if n == 1:
                name = v.decode()
            elif n == 2:
                pair = {f: x.decode() for f, w, x in fields(v) if w == 2}
                tags[pair.get(1, "")] = pair.get(2, "")
            else:
                ts, value = 0, 0.0
                for f, w, x in fields(v):
                    if f == 1 and w == 0:
                        ts = x - (1 << 64) if x >> 63 else x
                    elif f == 2 and w == 1:
                        value = struct.unpack("<d", x)[0]
                samples.append((ts, value))
        if not name:
            raise ValueError("measurement is missing")
        out += [{"measurement": name, "tags": tags, "fields": {VALUE_FIELD: parsed.field("f", v)}, "ts_ns": ts or None, "error": None} for ts, v in samples]
    return out


def _part(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def encode(series: list[tuple[str, dict[str, str], list[tuple[int, float]]]]) -> bytes:
    """A WriteRequest of (measurement, tags, samples)."""
    out = b""
    for name, tags, samples in series:
        body = _part(1, name.encode())
        body += b"".join(_part(2, _part(1, k.encode()) + _part(2, v.encode())) for k, v in tags.items())
        body += b"".join(_part(3, varint(8) + varint(ts) + varint(17) + struct.pack("<d", v)) for ts, v in samples)
        out += _part(1, body)
    return out


def rows(payloads: DataFrame, column: str = "value", seq: str | None = None) -> DataFrame:
    """parsed rows of a binary column; a bad payload gives one row with its error."""
    numbered = payloads.select(F.col(column).cast("binary").alias("raw"), (F.col(seq) if seq else F.monotonically_increasing_id()).cast("long").alias("seq"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for raw, n in zip(pdf["raw"], pdf["seq"], strict=True):
                if raw is None:
                    continue
                try:
                    each = decode(bytes(raw))
                except (ValueError, UnicodeDecodeError) as e:
                    each = [{"measurement": None, "tags": None, "fields": None, "ts_ns": None, "error": str(e)}]
                out += [{**x, "raw": bytes(raw).hex() if x["error"] else None, "seq": n} for x in each]
            yield pd.DataFrame(out, columns=["measurement", "tags", "fields", "ts_ns", "error", "raw", "seq"]).astype({"ts_ns": "Int64"})

    return numbered.mapInPandas(run, parsed.SCHEMA)


def encode_result(series: Column, ts_ms: Column, value: Column) -> Column:
    """A result row as binary: series = 1, time (zig-zag) = 2, value = 3."""

    @F.pandas_udf("binary")
    def run(s, t, v):
        import pandas as pd

        one = [_part(1, str(a).encode()) + varint(16) + varint(zigzag(int(b))) + varint(25) + struct.pack("<d", c) for a, b, c in zip(s, t, v, strict=True)]
        return pd.Series(one, index=s.index, dtype=object)

    return run(series, ts_ms, value)
