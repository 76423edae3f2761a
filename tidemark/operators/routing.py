"""Where series go: a shard for each by hash, by rendezvous hashing over named nodes, or by a tag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(key: Column, shards: int) -> Column:
    """0 to shards - 1."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def rendezvous(key: Column, nodes: Sequence[str]) -> Column:
    """The node whose digest with the key is the greatest. A node that comes takes only what it wins, and one that
    goes leaves only its own keys to others, so no more than its share of the keys ever moves."""
    if not nodes:
        raise ValueError("no nodes")
    drawn = [F.struct(F.md5(F.concat_ws("|", key, F.lit(n))).alias("weight"), F.lit(n).alias("node")) for n in sorted(set(nodes))]
    return F.array_max(F.array(*drawn))["node"]


def by_tag(tags: Column, tag: str, key: Column, shards: int) -> Column:
    """Series with one value of the tag share a shard; those without the tag go by their key."""
    return F.pmod(F.xxhash64(F.coalesce(tags[tag], key)), F.lit(shards)).cast("int")


def routed(points: DataFrame, shard: Column, partitions: int) -> DataFrame:
    """The points with their `shard`, those of a shard together in a partition."""
    return points.withColumn("shard", shard).repartition(partitions, "shard")


def moved(keys: DataFrame, key: str, before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """Keys by node before and after a change of nodes: from_node, to_node, n."""
    rows = keys.select(rendezvous(F.col(key), before).alias("from_node"), rendezvous(F.col(key), after).alias("to_node"))
    return rows.groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("n"))
