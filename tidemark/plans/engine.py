"""The front door: points in, queries in either language out."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import durations
from ..functions.aggregates import aggregate
from ..model import literal_ts
from ..operators import catalogue, chunks, maintenance
from ..sources import files
from . import ast, compiler, explain, promql, result, sql
from .lexer import QueryError, tokens


def parse(text: str, now_ms: int) -> ast.Query:
    """SELECT and EXPLAIN open SQL; everything else is PromQL."""
    words = [t.text.lower() for t in tokens(text)[:2]]
    return (sql if words and words[0] in ("select", "explain") else promql).parse(text, now_ms)


class Engine:
    """Queries over a frame of points. now_ms fixes the clock, for repeatable answers. keep: of the points of a series
    at one time, queries see the first arrival, the last, or, with None, all of them. path: where the points are stored,
    if they are."""

    def __init__(self, points: DataFrame, now_ms: int | None = None, keep: str | None = "first", path: str | None = None):
        if keep not in ("first", "last", None):
            raise ValueError("keep must be first, last or None")
        self.points, self.now_ms, self.keep, self.path = points, now_ms, keep, path

    @classmethod
    def open(cls, spark: SparkSession, path: str, now_ms: int | None = None, keep: str | None = "first") -> Engine:
        """Over stored points."""
        return cls(files.read(spark, path), now_ms, keep, path)

    def _now(self) -> int:
        return int(time.time() * 1000) if self.now_ms is None else self.now_ms

    def query(self, text: str) -> DataFrame:
        return self.run(parse(text, self._now()))

    def run(self, q: ast.Query) -> DataFrame:
        return (explain.explain if q.explain else compiler.compile)(q, self.points, self.keep)

    def result(self, text: str) -> result.QueryResult:
        """The frame with warnings on the number of buckets."""
        q = parse(text, self._now())
        said = durations.warning(compiler.interval(q), q.end_ms - q.start_ms) if q.window and not q.explain else None
        return result.QueryResult(self.run(q), (said,) if said else ())

    def aggregate(self, metric: str, function: str, start_ms: int, end_ms: int) -> DataFrame:
        """One value, by the names that the REST call takes: p95, mean, std, quantile0.9 ... QueryError for others."""
        if start_ms > end_ms:
            raise QueryError("the range ends before it starts")
        try:
            aggregate(function)
        except ValueError as e:
            raise QueryError(str(e)) from None
        return self.run(ast.Query("aggregate", metric, start_ms, end_ms, calls=(ast.Call(function, None, "value"),)))

    def stream(self, q: ast.Query | str, live: DataFrame) -> DataFrame:
        """The query over a stream of points instead, as streaming.queries.run() has it."""
        from ..streaming import queries

        return queries.run(parse(q, self._now()) if isinstance(q, str) else q, live)

    def series(self) -> DataFrame:
        return catalogue.series(self.points)

    def find(self, *args, **kwargs) -> DataFrame:
        """Series, by what catalogue.find() takes."""
        return catalogue.find(self.series(), *args, **kwargs)

    def _stored(self) -> str:
        if self.path is None:
            raise QueryError("the points aren't stored")
        return self.path

    def write(self, points: DataFrame) -> Engine:
        """Add points to the stored ones; the engine over both."""
        files.write(points, self._stored(), mode="append")
        return Engine.open(points.sparkSession, self._stored(), self.now_ms, self.keep)

    def delete(self, condition: Column, to: str) -> Engine:
        """Write what stays without the series that fit to a new place; the engine over it."""
        files.write(maintenance.delete_series(self.points, condition), to)
        return Engine.open(self.points.sparkSession, to, self.now_ms, self.keep)

    def integrity(self) -> DataFrame:
        return maintenance.integrity(self.points)

    def rebuild(self, to: str) -> DataFrame:
        """Write the catalogue of series anew from the points, and read it."""
        self.series().write.mode("overwrite").parquet(to)
        return self.points.sparkSession.read.parquet(to)

    def chunks(self, *args, **kwargs) -> DataFrame:
        """Stored files, by what chunks.listing() takes."""
        return chunks.listing(self.points.sparkSession, self._stored(), *args, **kwargs)

    def merge(self, **limits) -> DataFrame:
        """Merge small stored files, by what chunks.merge() takes."""
        return chunks.merge(self.points.sparkSession, self._stored(), **limits)

    def stats(self) -> DataFrame:
        """metric, series, points, first and last time."""
        from pyspark.sql import functions as F

        return self.points.groupBy("metric").agg(F.countDistinct("series_key").alias("series"), F.count(F.lit(1)).alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    def between(self, start_ms: int, end_ms: int) -> DataFrame:
        return self.points.where((self.points.ts >= literal_ts(start_ms)) & (self.points.ts <= literal_ts(end_ms)))
