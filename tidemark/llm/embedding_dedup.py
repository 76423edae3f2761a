"""Embedding near-duplicates: sign hashing in several tables, exact cosine, connected components.

Equal vectors of a label are one class from the start. Each class gets, for every table, the signs of its dot
products with some random hyperplanes; classes that share a label and a table's signs meet in a task with their
vectors and are compared in double precision. A pair belongs to the first table that holds it, so a task counts
its own pairs and sends a number a class and a forest of links, never the pairs. Crowded buckets are cut into
blocks, and pairs of blocks meet in tasks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import bounded_batches, save

COSINE = 0.98
#: Chance to miss a pair right at the threshold, and the mean bucket size aimed at.
MISS, CROWD = 1e-4, 8
#: Classes of a bucket that meet in one task, at most twice, and rows of them that are compared at once.
BLOCK, STEP = 2048, 128
#: Classes of a bucket up to which its pairs are compared along with those of others, and pairs compared at once.
SMALL, PAIRS = 64, 1 << 15
SEED = 20240131
LEAST_LONG = -(1 << 63)

MET = "a binary, b binary, n long"


def plan(classes: int) -> tuple[int, int]:
    """(bits, tables): enough bits that buckets stay small, enough tables to find pairs at the threshold."""
    bits = max(4, math.ceil(math.log2(max(classes, 2) / CROWD)))
    same = 1 - math.acos(COSINE) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - same**bits))


def _codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The signs of each vector in each table, as a number."""
    planes = np.random.default_rng(SEED + vectors.shape[1]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _key(least: Column, digest: Column) -> Column:
    """24 bytes that sort by the least id, then by the digest: the least key of a component names it."""
    number = F.hex(least.bitwiseXOR(F.lit(LEAST_LONG)))
    return F.unhex(F.concat(F.lpad(number, 16, "0"), F.hex(digest)))


def _least_of(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(LEAST_LONG))


class Met:
    """Rows of whole units, which are pairs of blocks of a bucket, in order of units, with vectors of one length."""

    def __init__(self, rows: list[tuple], dtype: str):
        units, tabs, los, his, owns, self.keys, copies, vectors, codes = zip(*rows, strict=True)
        n = len(rows)
        self.vectors = np.frombuffer(b"".join(vectors), dtype).reshape(n, -1).astype(float)
        self.codes = np.frombuffer(b"".join(codes), np.int64).reshape(n, -1)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.copies, self.tab = np.array(copies, float), np.array(tabs)
        self.lo, self.hi, self.own = np.array(los), np.array(his), np.array(owns)
        self.starts = np.array([k for k in range(n) if k == 0 or units[k] != units[k - 1]])
        self.ends = np.append(self.starts[1:], n)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of rows that a unit brings together, with a cosine of COSINE or more, i ascending."""
        size = self.ends - self.starts
        small = (size <= SMALL) & (self.lo[self.starts] == self.hi[self.starts])
        later = np.zeros(len(self.keys), np.int64)  # rows of small units: those after them in their unit
        for a, b in zip(self.starts[small].tolist(), self.ends[small].tolist(), strict=True):
            later[a:b] = np.arange(b - a - 1, -1, -1)
        for part in np.split(np.arange(len(later)), np.flatnonzero(np.diff(np.cumsum(later) // PAIRS)) + 1):
            i = np.repeat(part, later[part])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[part]) - later[part], later[part])
            near = np.einsum("ij,ij->i", self.vectors[i], self.vectors[j]) / (self.norm[i] * self.norm[j]) >= COSINE
            yield i[near], j[near]
        for a, b in zip(self.starts[~small].tolist(), self.ends[~small].tolist(), strict=True):
            left, right = (a + np.flatnonzero(self.own[a:b] == x) for x in (self.lo[a], self.hi[a]))
            for some in np.split(left, range(STEP, len(left), STEP)):
                x, y = np.nonzero(self.vectors[some] @ self.vectors[right].T / (self.norm[some, None] * self.norm[None, right]) >= COSINE)
                i, j = some[x], right[y]
                once = (i < j) | (self.lo[a] != self.hi[a])
                yield i[once], j[once]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of the candidates that share the signs of their unit's table and of no table before it."""
        for i, j in self.candidates():
            own = self.codes[i, self.tab[i]] == self.codes[j, self.tab[i]]
            i, j = i[own], j[own]
            for t in range(self.codes.shape[1]):
                new = (self.codes[i, t] != self.codes[j, t]) | (self.tab[i] <= t)
                i, j = i[new], j[new]
            if len(i):
                yield i, j

    def found(self) -> pa.RecordBatch:
        """MET: by row the number of linked vectors (a, null, n), and a forest of the links (a, b, null)."""
        total, group, edges = np.zeros(len(self.keys)), np.arange(len(self.keys)), []
        for i, j in self.links():
            total += np.bincount(i, self.copies[j], len(total)) + np.bincount(j, self.copies[i], len(total))
            for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                one, some = i[part[0]], j[part]
                others, first = np.unique(group[some], return_index=True)
                apart = others != group[one]
                if apart.any():
                    edges += [(one, some[k]) for k in first[apart].tolist()]
                    group[np.isin(group, others)] = group[one]
        n = np.flatnonzero(total)
        a = [self.keys[k] for k in n.tolist()] + [self.keys[x] for x, _ in edges]
        b = [None] * len(n) + [self.keys[y] for _, y in edges]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([*total[n].astype(np.int64).tolist(), *[None] * len(edges)], pa.int64())], names=["a", "b", "n"])


def _met(batches: Iterable[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    """MET of rows sorted by unit. Small units are compared many at a time; a unit that a batch cuts waits for its rest."""
    held: list[tuple] = []
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        units = zip(cols["bucket"], cols["lo"], cols["hi"], strict=True)
        held += zip(units, *(cols[c] for c in ("tab", "lo", "hi", "own", "key", "copies", "vector", "codes")), strict=True)
        last = next((k for k in range(len(held) - 1, -1, -1) if held[k][0] != held[-1][0]), -1) + 1
        yield from _of_lengths(held[:last], dtype)
        held = held[last:]
    yield from _of_lengths(held, dtype)


def _of_lengths(rows: list[tuple], dtype: str) -> Iterator[pa.RecordBatch]:
    for size in sorted({len(r[7]) for r in rows}):
        yield Met([r for r in rows if len(r[7]) == size], dtype).found()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per input row. Vectors that are null, empty or zero, or hold
    null or non-finite numbers, and those without label or id, link with nothing, nor do vectors of different
    lengths. Rows repeated with one id are linked with each other as any equal vectors are."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    dtype = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit, F.lit(False))
    # The label's length goes first, so that no label runs into the numbers.
    digest = F.sha2(F.concat_ws(",", F.length("label").cast("string"), F.col("label"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256)
    rows = save(rows.withColumn("class", F.when(usable, F.unhex(F.substring(digest, 1, 32)))), "vectors")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = save(classes.withColumn("key", _key(F.col("least"), F.col("class"))), "vector-classes")
    bits, tables = plan(classes.count())

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            key, copies, label, vecs = (batch.column(c).to_pylist() for c in ("key", "copies", "label", "v"))
            for size in sorted({len(x) for x in vecs}):
                i = [k for k, x in enumerate(vecs) if len(x) == size]
                own = np.array([vecs[k] for k in i])
                codes = _codes(own, bits, tables)
                buckets = [[xxhash.xxh3_128_digest(f"{label[k]}/{size}/{t}/{c}") for t, c in enumerate(row)] for k, row in zip(i, codes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key[k] for k in i], pa.binary()), pa.array([copies[k] for k in i], pa.int64()), pa.array([x.astype(dtype).tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(buckets, pa.list_(pa.binary()))], names=["key", "copies", "vector", "codes", "buckets"])

    signs = save(classes.select("key", "copies", "label", "v").mapInArrow(hashed, "key binary, copies long, vector binary, codes binary, buckets array<binary>"), "signs")
    members = signs.select("key", F.posexplode("buckets").alias("tab", "bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    meets = meets.join(signs.select("key", "copies", "vector", "codes"), "key")
    units = meets.select("bucket", "tab", "lo", "hi", "own", "key", "copies", "vector", "codes").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    met = save(units.mapInArrow(lambda batches: _met(batches, dtype), MET), "vector-links")
    group = components(met.where("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    degree = met.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("linked"))
    per_class = classes.select("class", "key", "copies").join(group, "key", "left").join(degree, "key", "left")
    per_class = per_class.select("class", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), _least_of(F.coalesce("component", "key")).alias("component_id"))
    out = rows.select("vec_id", "class").join(per_class, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
