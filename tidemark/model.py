"""The canonical frame of points.

points: series_key string, metric string, tags map<string,string>, ts timestamp_ntz, value double, seq long.
`seq` is the arrival order, which breaks every tie. NaN becomes null on the way in: null then means "no value",
comparisons with it are false, and min, max, sum and avg skip it. count counts rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("series_key", "metric", "tags", "ts", "value", "seq")


def series_key(metric: Column, tags: Column) -> Column:
    """`metric,k=v,k=v` with the tags in order of their keys."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat_ws(",", F.array(metric), pairs)


def series_id(metric: Column, tags: Column) -> Column:
    """A 64-bit surrogate of the series key."""
    return F.xxhash64(series_key(metric, tags))


def micros(ts: Column | str = "ts") -> Column:
    """Microseconds since the epoch; timestamps without zone count as UTC (the session's zone)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def millis(ts: Column | str = "ts") -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def at_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def literal_ts(ms: int) -> Column:
    """A constant timestamp, so that a filter on it reaches the scan."""
    from datetime import datetime, timedelta

    return F.lit((datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def points(df: DataFrame, metric: Column, tags: Column, ts: Column, value: Column, seq: Column) -> DataFrame:
    v = value.cast("double")
    return df.select(series_key(metric, tags).alias("series_key"), metric.alias("metric"), tags.alias("tags"), ts.cast("timestamp_ntz").alias("ts"), F.when(~F.isnan(v), v).alias("value"), seq.cast("long").alias("seq"))


def from_events(events: DataFrame) -> DataFrame:
    tags = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    return points(events, F.col("event_type"), tags, F.col("ts"), F.col("value"), F.col("event_id"))


def from_orders(orders: DataFrame) -> DataFrame:
    tags = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    return points(orders, F.lit("order_total"), tags, F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """seq orders by order and line only; the five columns that order lineitem wholly are a struct in dedup."""
    tags = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    return points(lineitem, F.lit("lineitem_price"), tags, F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_orderkey") * 10 + F.col("l_linenumber"))
