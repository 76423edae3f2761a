"""Sharding by extendible hashing.

A document's hash bits lead through a directory of prefixes. A bucket within the byte limit is a shard; only an
oversized bucket splits, on its next bit. Sizes of all prefixes of a chunk of bits come from one aggregation, and
only documents under prefixes still too large go to the next chunk. The bits of the content hash are followed by
those of a row number, so that repeated rows can part as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import partitions, save

SHARD_BYTES = 32 << 20
#: Bits of each of a document's two hashes, and the most bits that one aggregation looks at.
WORD, CHUNK = 60, 20
#: Directory rows of about 40 bytes up to which the directory is broadcast.
BROADCAST_ROWS = 100_000


def _hashes(id_col: str, text_col: str) -> list[Column]:
    """Two 60-bit numbers: of the content by MD5, so that SQL engines agree, and of the row's number."""
    content = F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    return [F.conv(F.substring(content, 1, 15), 16, 10).cast("long"), F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)]


def _bits(start: int, n: int) -> Column:
    """The n bits from `start` of the document's 120; they lie in one of the two words."""
    word, at = ("__h1", start) if start < WORD else ("__h2", start - WORD)
    return F.shiftright(F.col(word), WORD - at - n).bitwiseAND(F.lit((1 << n) - 1))


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """rows, which hold __h1, __h2 and n_bytes, with depth, shard and oversized."""
    names = rows.columns
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first = max(1, min(CHUNK, math.ceil(math.log2(max(1, total / limit))) + 3))
    left, done, at = rows.withColumn("__prefix", F.lit("")), [], 0
    while True:
        n = min(first if at == 0 else CHUNK, (WORD if at < WORD else 2 * WORD) - at)
        keyed = left.withColumn("__bits", _bits(at, n))
        fine = keyed.groupBy("__prefix", "__bits").agg(F.sum("n_bytes").alias("size"), F.count(F.lit(1)).alias("docs"))
        path = fine.withColumn("d", F.explode(F.sequence(F.lit(0 if at == 0 else 1), F.lit(n)))).withColumn("node", F.expr(f"shiftright(__bits, {n} - d)"))
        sized = path.groupBy("__prefix", "d", "node").agg(F.sum("size").alias("size"), F.sum("docs").alias("docs"))
        # Rows whose 120 bits all agree share the last shard; for less than billions of repeats there are none.
        fits = sized.where((F.col("size") <= limit) | (F.col("docs") == 1) | (F.lit(at) + F.col("d") == 2 * WORD))
        leaf = path.select("__prefix", "__bits", "d", "node").join(fits, ["__prefix", "d", "node"]).groupBy("__prefix", "__bits").agg(F.min(F.struct("d", "size")).alias("leaf"))
        leaf = save(leaf.select("__prefix", "__bits", F.col("leaf.d").alias("__d"), F.col("leaf.size").alias("__size")), "directory")
        joined = keyed.join(F.broadcast(leaf) if leaf.count() <= BROADCAST_ROWS else leaf, ["__prefix", "__bits"], "left")
        code = F.lpad(F.conv(F.col("__bits").cast("string"), 10, 2), n, "0")
        found = joined.where("__d is not null")
        done.append(found.select(*names, (F.lit(at) + F.col("__d")).alias("depth"), F.concat("__prefix", F.substring(code, F.lit(1), F.col("__d"))).alias("shard"), (F.col("__size") > limit).alias("oversized")))
        at += n
        left = save(joined.where("__d is null").withColumn("__prefix", F.concat("__prefix", code)).select(*names, "__prefix"), "oversized")
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("__h1", "__h2")


def assign(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, shard (the prefix's bits, empty for a single shard), oversized (a single document
    over the limit, alone in its shard), a row per input row. A null text has no bytes; a null id hashes as
    empty; an empty table has no shards."""
    h1, h2 = _hashes(id_col, text_col)
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return _placed(save(docs.select(F.col(id_col).cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), h1.alias("__h1"), h2.alias("__h2")), "hashed"), limit)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs, all columns, as Parquet under path, a folder `shard_bits=s<bits>` for each shard (with further
    underscores before the `=` where docs has a column of that name); returns the directory: shard, depth, n_docs,
    n_bytes. A task gets whole shards, which the limit bounds."""
    column = "shard_bits"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    h1, h2 = _hashes(id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    placed = _placed(save(docs.select(row.alias("__row"), n_bytes.alias("n_bytes"), h1.alias("__h1"), h2.alias("__h2")), "hashed"), limit)
    named = placed.select("__row.*", F.concat(F.lit("s"), "shard").alias(column))
    named.repartition(partitions(docs.sparkSession), column).write.partitionBy(column).parquet(path)
    return placed.groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
