"""Results in the shapes that clients read."""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import tag_text
from ..model import millis
from ..operators import topk
from ..sources import protobuf

TABLE_ROWS = 100


@dataclass
class QueryResult:
    """A frame with what is to be said about it."""

    frame: DataFrame
    warnings: tuple[str, ...] = ()

    def capped(self, most: int = topk.MOST_ROWS) -> QueryResult:
        frame, cut = topk.capped(self.frame, most)
        return QueryResult(frame, self.warnings + ((f"cut to {most} rows",) if cut else ()))

    def to_json(self) -> DataFrame:
        """A JSON text a row; nulls are written."""
        return self.frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def write_csv(self, path: str, by_series: bool = False) -> None:
        """timestamp, series_id, value, or the series first."""
        cols = [millis().alias("timestamp"), F.col("series_key").alias("series_id"), F.col("value")]
        rows = self.frame.select(*([cols[1], cols[0], cols[2]] if by_series else cols))
        rows.write.csv(path, header=True)

    def to_table(self, rows: int = TABLE_ROWS) -> str:
        """The first rows as text."""
        return self.frame._show_string(rows, False)

    def to_protobuf(self) -> DataFrame:
        """A binary message a row, and it in base64."""
        encoded = protobuf.encode_result(F.col("series_key"), millis(), F.col("value"))
        return self.frame.select(encoded.alias("message")).withColumn("text", F.base64("message"))


def series_data(points: DataFrame, most_points: int | None = None) -> DataFrame:
    """A row per series: metric, scope (its tags joined), tag_set, pointlist of [ms, value], length. A point list is
    as long as its series; most_points keeps the latest of each and is what a client asks for."""
    rows = points if most_points is None else topk.latest_per_series(points, most_points)
    listed = rows.groupBy("series_key").agg(F.first("metric").alias("metric"), F.first(tag_text(F.col("tags"))).alias("tag_set"), F.array_sort(F.collect_list(F.struct(millis().alias("timestamp"), "value"))).alias("pointlist"))
    return listed.select("metric", F.array_join("tag_set", ",").alias("scope"), "tag_set", "pointlist", F.size("pointlist").cast("long").alias("length"))


def decode_text(text: str) -> list[tuple]:
    """(field, wire type, value) of a base64 message."""
    return list(protobuf.fields(base64.b64decode(text)))
