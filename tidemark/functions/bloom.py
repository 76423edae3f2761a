"""Bloom filters over columns, of a fixed size, with Spark's bitmap aggregates.

A filter is a frame (bucket, bitmap): each bucket covers 32,768 bits. Its size doesn't grow with the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, HASHES = 1 << 20, 5
_BUCKET = 1 << 15


def sized(items: int, error: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for so many items at a chance of error: whole buckets."""
    bits = -items * math.log(error) / math.log(2) ** 2
    whole = max(1, math.ceil(bits / _BUCKET)) * _BUCKET
    return whole, max(1, round(whole / max(1, items) * math.log(2)))


def _positions(value: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)) + 1 for i in range(hashes)]


def build(df: DataFrame, column: str, bits: int = BITS, hashes: int = HASHES) -> DataFrame:
    """The filter of the column's values; nulls are left out."""
    at = df.where(F.col(column).isNotNull()).select(F.explode(F.array(*_positions(F.col(column), bits, hashes))).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of both filters' values; both must have the same sizes."""
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def with_membership(df: DataFrame, column: str, bloom: DataFrame, bits: int = BITS, hashes: int = HASHES, name: str = "maybe") -> DataFrame:
    """df with `name`: false where the filter rules the value out. The filter, of bits / 8 bytes, is broadcast as one row."""
    packed = bloom.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bitmap"))).alias("__bloom"))

    def holds(at: Column) -> Column:
        bit = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring(F.col("__bloom")[F.bitmap_bucket_number(at)], (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))

    every = holds(_positions(F.col(column), bits, hashes)[0])
    for at in _positions(F.col(column), bits, hashes)[1:]:
        every = every & holds(at)
    return df.crossJoin(F.broadcast(packed)).withColumn(name, every).drop("__bloom")
