"""Sorting, limits, latest points and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a result beyond which it is cut and marked.
MOST_ROWS = 1_000_000
FIELDS = {"time": "ts", "timestamp": "ts", "ts": "ts", "value": "value", "bucket": "bucket"}


def sort(df: DataFrame, order: tuple[tuple[str, bool], ...], ties: tuple[str, ...] = ("series_key", "seq")) -> DataFrame:
    """By (field, descending) pairs, nulls last, then by the tie columns that are there; unknown fields are an error."""
    columns = []
    for field, down in order:
        name = FIELDS.get(field, field)
        if name not in df.columns:
            raise ValueError(f"can't order by {field!r}")
        columns.append(F.desc_nulls_last(name) if down else F.asc_nulls_last(name))
    return df.orderBy(*columns, *[F.asc(c) for c in ties if c in df.columns])


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def latest(points: DataFrame, n: int) -> DataFrame:
    """The n latest points of all, oldest first: a partial top-n in each task, no full sort."""
    return points.orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq")


def latest_per_series(points: DataFrame, n: int, key: str = "series_key") -> DataFrame:
    """The n latest points of every series. Spark cuts each task's groups to n before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    return points.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def top(rows: DataFrame, k: int, value: str = "value", key: str = "series_key", largest: bool = True) -> DataFrame:
    """The k rows of the largest (or smallest) values; nulls are skipped, ties go to the smaller key."""
    return rows.where(F.col(value).isNotNull()).orderBy(F.desc(value) if largest else F.asc(value), key).limit(k)


def merged(sources: list[DataFrame], limit: int | None = None, keep: str | None = None) -> DataFrame:
    """The points of all sources in order of time, of repeated ones the first or last arrival if asked for; with a
    limit each task hands on no more than that many."""
    from .dedup import dedup

    every = reduce(DataFrame.unionByName, sources)
    return page(sort(every if keep is None else dedup(every, keep), (("time", False),)), limit, 0)


def capped(df: DataFrame, most: int = MOST_ROWS) -> tuple[DataFrame, bool]:
    """(df cut to `most` rows, whether any were cut)."""
    more = df.limit(most + 1).count() > most
    return (df.limit(most) if more else df), more
