"""Live points: tailing, windows with a watermark, changes of value, deduplication.

Streams are pulled in micro-batches: the source's options (maxFilesPerTrigger, maxOffsetsPerTrigger) take the part of
back pressure, checkpoints that of a write-ahead log, state time-outs that of clearing stale subscribers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.aggregates import aggregate
from ..operators import selectors
from ..plans import ast

LATENESS = "10 minutes"


def follow(spark: SparkSession, path: str, schema, files_a_batch: int = 16, pattern: str | None = None) -> DataFrame:
    """A stream of the rows of Parquet files as they arrive."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of the lines (value, seq) that a TCP sender writes: seq is the time of arrival. For trials, as Spark
    can't ask a socket again after a failure."""
    rows = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return rows.select("value", F.unix_micros("timestamp").alias("seq"))


def kafka_lines(spark: SparkSession, servers: str, topic: str, offsets_a_batch: int = 1_000_000, starting: str = "latest") -> DataFrame:
    """A stream of a topic's messages as lines (value, seq: the offset); needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    rows = reader.option("startingOffsets", starting).option("maxOffsetsPerTrigger", offsets_a_batch).load()
    return rows.select(F.col("value").cast("string").alias("value"), F.col("offset").alias("seq"))


def tail(points: DataFrame, metric: str | None = None, where: ast.Condition | None = None) -> DataFrame:
    """The points that fit, as they come."""
    rows = points if metric is None else points.where(F.col("metric") == metric)
    return rows if where is None else rows.where(selectors.condition(where))


def _timed(points: DataFrame, lateness: str) -> DataFrame:
    return points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def deduped(points: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The first arrival for each series and time; repeats count as such for as long as the watermark allows."""
    return _timed(points, lateness).dropDuplicatesWithinWatermark(["series_key", "ts"])


def windowed(points: DataFrame, calls: tuple[ast.Call, ...], interval: str, slide: str | None = None, keys: tuple[str, ...] = ("metric",), lateness: str = LATENESS) -> DataFrame:
    """keys, bucket, bucket_end, calls: a window's row comes out (append mode) once the watermark has passed it;
    later points are dropped and counted in the progress as numRowsDroppedByWatermark."""
    w = F.window("ts", interval, slide).alias("w")
    named = [aggregate(c.function, c.arg).alias(c.name) for c in calls]
    rows = _timed(points, lateness).groupBy(*keys, w).agg(*named)
    return rows.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("bucket"), F.col("w.end").cast("timestamp_ntz").alias("bucket_end"), *[c.name for c in calls])


def sessions(points: DataFrame, gap: str, keys: tuple[str, ...] = ("series_key",), lateness: str = LATENESS) -> DataFrame:
    """keys, bucket, bucket_end, count of runs of points less than gap apart."""
    rows = _timed(points, lateness).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("count"))
    return rows.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("bucket"), F.col("w.end").cast("timestamp_ntz").alias("bucket_end"), "count")


CHANGE = "series_key string, ts timestamp, value double, before double, sequence long"


def changes(points: DataFrame, idle_ms: int = 86_400_000, lateness: str = LATENESS) -> DataFrame:
    """CHANGE: a row where a series' value differs from the one before it, the first included; sequence numbers a
    series' rows. A series that the watermark leaves behind by idle_ms is forgotten."""

    def run(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, sequence = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        value, before = pdf["value"].astype(float), pdf["value"].astype(float).shift()
        before.iloc[0] = float("nan") if last is None else last
        other = (value != before) & ~(value.isna() & before.isna())
        other.iloc[0] |= sequence == 0
        found = pd.DataFrame({"series_key": key[0], "ts": pdf["ts"], "value": value, "before": before})[other]
        found["sequence"] = range(sequence + 1, sequence + 1 + len(found))
        final = value.iloc[-1]
        state.update((None if pd.isna(final) else float(final), sequence + len(found)))
        newest = int(pdf["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield found.astype({"value": "Float64", "before": "Float64"})

    rows = _timed(points.select("series_key", "ts", "value", "seq"), lateness)
    return rows.groupBy("series_key").applyInPandasWithState(run, CHANGE, "last double, sequence long", "append", GroupStateTimeout.EventTimeTimeout)


def each_batch(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Start the stream; call gets each batch and its number, and a batch again after a failure, with its number."""
    writer = stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run over all that is there, write the rows to the folder (shared by driver and executors), and read them."""
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
