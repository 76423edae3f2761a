"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_KEY = "__row_key"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_open: list[list[str]] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables saved meanwhile at the end, but for those saved with keep."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def save(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and return a reader of it: its lineage ends there, so a lost
    executor costs no more than the running stage. A plan that yields no file yields an empty table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _open and not keep:
        _open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small in the workers' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


@contextlib.contextmanager
def few_records(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most n records meanwhile, for rows that are whole segments."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits of a row's content: the same after any retry, equal only for repeated rows."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
