"""Parsed points, before they become points: one row per measurement and time, with all its fields.

parsed: measurement string, tags map<string,string>, fields map<string,field>, ts_ns long (nanoseconds, null if not
given), error string (null for a good row), raw string, seq long. A field has a kind (f i u s b) and its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import at_micros, series_key

FIELD = "struct<kind:string,f:double,i:bigint,u:decimal(20,0),s:string,b:boolean>"
SCHEMA = f"measurement string, tags map<string,string>, fields map<string,{FIELD}>, ts_ns long, error string, raw string, seq long"
FIELD_TAG = "__field__"


def field(kind: str, value) -> dict:
    """A field as a Python dict."""
    return {"kind": kind, **{k: value if k == kind else None for k in "fiusb"}}


def as_double(f: Column) -> Column:
    """The number of a numeric field; null for text and booleans."""
    return F.coalesce(f["f"], f["i"].cast("double"), f["u"].cast("double"))


def as_bool(f: Column) -> Column:
    """The truth of a boolean field, of a number (not 0), or of the words true and false; else null."""
    word = F.lower(f["s"])
    return F.coalesce(f["b"], as_double(f) != 0, F.when(word == "true", True).when(word == "false", False))


def as_text(f: Column) -> Column:
    """Any field as text."""
    return F.coalesce(f["s"], f["i"].cast("string"), f["u"].cast("string"), f["f"].cast("string"), f["b"].cast("string"))


def explode(parsed: DataFrame, now_ns: Column | int, measurement_key: bool = True) -> DataFrame:
    """Points: a row per numeric field, with the field's name in the tag `__field__`. Rows with an error, and
    text and boolean fields, give none. Rows without a time get now_ns; nanoseconds are rounded down to
    microseconds."""
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    rows = parsed.where("error is null").select("measurement", "tags", F.coalesce("ts_ns", now).alias("ns"), "seq", F.explode("fields").alias("field", "f"))
    v = as_double(F.col("f"))
    tags = F.map_concat(F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, x: k != FIELD_TAG), F.create_map(F.lit(FIELD_TAG), F.col("field")))
    found = rows.where(v.isNotNull()).select(F.col("measurement").alias("metric"), tags.alias("tags"), at_micros(F.floor(F.col("ns") / 1000)).alias("ts"), F.when(~F.isnan(v), v).alias("value"), "seq")
    return found.select(series_key(F.col("metric"), F.col("tags")).alias("series_key"), "metric", "tags", "ts", "value", "seq")
