"""Line protocol: `measurement,tag=v field=1.5,other=2i 1700000000000000000`."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import parsed

# Lines that need no scanner: printable ASCII without quotes and escapes, plain numbers and truth values.
_CHAR = r"[\x21\x23-\x2B\x2D-\x3C\x3E-\x5B\x5D-\x7E]"
_LONG = r"(?:[1-8][0-9]{18}|[0-9]{1,18})"
_PLAIN = rf"(?:-?{_LONG}i|{_LONG}u|-?[0-9]{{1,15}}(?:\.[0-9]{{1,15}})?|true|false|True|False|TRUE|FALSE|[tTfF])"
_SIMPLE = rf"\A(?!#){_CHAR}++(?:,{_CHAR}++={_CHAR}++)*+ {_CHAR}++={_PLAIN}(?:,{_CHAR}++={_PLAIN})*+(?: -?{_LONG})?\z"

_TRUE, _FALSE = {"t", "T", "true", "True", "TRUE"}, {"f", "F", "false", "False", "FALSE"}


def split(text: str, at: str, quotes: bool = False, most: int = -1) -> list[str]:
    """The parts between unescaped (and, on request, unquoted) separators, escapes left in."""
    parts, start, i, quoted = [], 0, 0, False
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == '"' and quotes:
            quoted = not quoted
        elif c == at and not quoted and most != 0:
            parts.append(text[start:i])
            start = i + 1
            most -= 1
        i += 1
    if quoted:
        raise ValueError("open quote")
    return [*parts, text[start:]]


def unescape(text: str, marks: str) -> str:
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in marks:
            i += 1
        out.append(text[i])
        i += 1
    return "".join(out)


def value(text: str) -> dict:
    if len(text) >= 2 and text[0] == text[-1] == '"':
        return parsed.field("s", unescape(text[1:-1], '"\\'))
    if text in _TRUE or text in _FALSE:
        return parsed.field("b", text in _TRUE)
    if "_" not in text and text[-1:] == "i":
        n = int(text[:-1])
        if not -(1 << 63) <= n < 1 << 63:
            raise ValueError("integer out of range")
        return parsed.field("i", n)
    if "_" not in text and text[-1:] == "u":
        n = int(text[:-1])
        if not 0 <= n < 1 << 64:
            raise ValueError("unsigned integer out of range")
        return parsed.field("u", Decimal(n))
    x = float("x" if "_" in text else text)
    if not math.isfinite(x):
        raise ValueError("number isn't finite")
    return parsed.field("f", x)


def _pairs(parts: list[str], what: str, read) -> dict:
    out: dict = {}
    for p in parts:
        both = split(p, "=", most=1)
        if len(both) < 2 or not all(both):
            raise ValueError(f"bad {what}: {p!r}")
        key, v = both
        key = unescape(key, ",= \\")
        if key in out:
            raise ValueError(f"{what} given twice: {key!r}")
        out[key] = read(v)
    return out


def parse(text: str) -> dict | None:
    """A parsed row as a dict; None for blank lines and comments; ValueError says what is wrong."""
    text = text.strip()
    if not text or text[0] == "#":
        return None
    head, *rest = split(text, " ", quotes=True)
    rest = [x for x in rest if x]
    if not 1 <= len(rest) <= 2:
        raise ValueError("fields are missing" if not rest else "too many parts")
    name, *tags = split(head, ",")
    if not name:
        raise ValueError("measurement is missing")
    ts = int(rest[1]) if len(rest) == 2 and "_" not in rest[1] else None
    if len(rest) == 2 and (ts is None or not -(1 << 63) <= ts < 1 << 63):
        raise ValueError("bad time")
    return {"measurement": unescape(name, ", \\"), "tags": _pairs(tags, "tag", lambda v: unescape(v, ",= \\")), "fields": _pairs(split(rest[0], ",", quotes=True), "field", value), "ts_ns": ts, "error": None}


def _plain_field(text: Column) -> Column:
    v, last = F.substring_index(text, "=", -1), F.right(text, F.lit(1))
    short = F.left(v, F.length(v) - 1)
    kind = F.when(F.left(v, F.lit(1)).isin(*"tTfF"), "b").when(last == "i", "i").when(last == "u", "u").otherwise("f")
    value = {"f": v.try_cast("double"), "i": short.try_cast("long"), "u": short.try_cast("decimal(20,0)"), "s": F.lit(None).cast("string"), "b": F.lower(F.left(v, F.lit(1))) == "t"}
    return F.struct(kind.alias("kind"), *[(x if k == "s" else F.when(kind == k, x)).alias(k) for k, x in value.items()])


def _names(pairs: Column) -> Column:
    return F.transform(pairs, lambda x: F.substring_index(x, "=", 1))


def _plain(parts: DataFrame) -> DataFrame:
    """Parsed rows of simple lines, within the JVM."""
    map_of = lambda pairs, of: F.map_from_arrays(_names(pairs), F.transform(pairs, of))
    return parts.select(
        F.get("head", F.lit(0)).alias("measurement"),
        map_of(F.col("tag_pairs"), lambda x: F.substring_index(x, "=", -1)).alias("tags"),
        map_of(F.col("field_pairs"), _plain_field).alias("fields"),
        F.get("parts", F.lit(2)).cast("long").alias("ts_ns"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("raw"),
        "seq",
    )


def numbered(lines: DataFrame, column: str, seq: str | None) -> DataFrame:
    """(raw, seq) of a column of texts."""
    return lines.select(F.col(column).cast("string").alias("raw"), (F.col(seq) if seq else F.monotonically_increasing_id()).cast("long").alias("seq"))


def rows(lines: DataFrame, column: str = "value", seq: str | None = None) -> DataFrame:
    """parsed rows of a column of lines; bad lines carry their error and text, blank and comment lines none. Simple
    lines are split by Spark's own functions; only those with quotes, escapes, other characters, unusual numbers or
    names given twice go to the scanner."""
    parts = numbered(lines, column, seq).withColumn("parts", F.split("raw", " "))
    parts = parts.withColumns({"head": F.split(F.get("parts", F.lit(0)), ","), "field_pairs": F.split(F.get("parts", F.lit(1)), ",")})
    parts = parts.withColumn("tag_pairs", F.slice("head", 2, F.greatest(F.size("head") - 1, F.lit(0))))
    once = lambda pairs: F.size(F.array_distinct(_names(F.col(pairs)))) == F.size(pairs)
    simple = F.coalesce(F.col("raw").rlike(_SIMPLE) & once("tag_pairs") & once("field_pairs"), F.lit(False))
    return _plain(parts.where(simple)).unionByName(scanned(parts.where(~simple).select("raw", "seq")))


def scanned(texts: DataFrame, parse=parse) -> DataFrame:
    """parsed rows of (raw, seq), each by the parser."""

    def run(batches) -> Iterator:
        import pandas as pd

        columns = [x.split()[0] for x in ("measurement", "tags", "fields", "ts_ns", "error", "raw", "seq")]
        for pdf in batches:
            out = []
            for raw, n in zip(pdf["raw"], pdf["seq"], strict=True):
                try:
                    found = parse(raw) if isinstance(raw, str) else None
                    each = found if isinstance(found, list) else [found]
                except (ValueError, ArithmeticError) as e:
                    each = [{"measurement": None, "tags": None, "fields": None, "ts_ns": None, "error": str(e)}]
                out += [{**x, "raw": raw if x["error"] else None, "seq": n} for x in each if x is not None]
            # Times apart, as a column of numbers and nulls would go through doubles and lose nanoseconds.
            yield pd.DataFrame(out, columns=columns).assign(ts_ns=pd.array([x["ts_ns"] for x in out], dtype="Int64"))

    return texts.mapInPandas(run, parsed.SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    return rows(spark.read.text(path))
