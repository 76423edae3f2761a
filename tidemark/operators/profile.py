"""Profiles of series: differences, entropy, moments, autocorrelation, bit patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import micros

KEY = "series_key"


def _ordered(key: str) -> Window:
    return Window.partitionBy(key).orderBy("ts", "seq")


def delta_of_delta(points: DataFrame, key: str = KEY) -> DataFrame:
    """key, ts, seq, delta_us, dod_us: the first time has neither, the second no dod."""
    w = _ordered(key)
    d = points.withColumn("delta_us", micros() - F.lag(micros()).over(w))
    return d.withColumn("dod_us", F.col("delta_us") - F.lag("delta_us").over(w)).select(key, "ts", "seq", "delta_us", "dod_us")


def from_delta_of_delta(coded: DataFrame, first: DataFrame, key: str = KEY) -> DataFrame:
    """key, seq, ts_us back from the differences and first(key, ts_us); seq orders the points."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = coded.withColumn("delta", F.sum(F.coalesce("dod_us", "delta_us", F.lit(0))).over(w))
    d = d.withColumn("delta", F.when(F.col("delta_us").isNull(), 0).otherwise(F.col("delta")))
    return d.join(first, key).select(key, "seq", (F.col("ts_us") + F.sum("delta").over(w)).alias("ts_us"))


def residuals(points: DataFrame, key: str = KEY) -> DataFrame:
    """key, ts, seq, residual: the value less the line through the two points before it."""
    w = _ordered(key)
    a, b = F.lag("value", 1).over(w), F.lag("value", 2).over(w)
    return points.withColumn("residual", F.col("value") - (a + (a - b))).where("residual is not null").select(key, "ts", "seq", "residual")


def byte_entropy(df: DataFrame, column: str, *by: str) -> DataFrame:
    """by..., entropy in bits a byte of the column's text or binary, over all rows of a group."""
    hexed = F.regexp_extract_all(F.hex(F.col(column)), F.lit("(..)"), F.lit(1))
    counts = df.select(*by, F.explode(hexed).alias("byte")).groupBy(*by, "byte").agg(F.count(F.lit(1)).alias("n"))
    # -sum(p log2 p) = log2 N - sum(n log2 n) / N
    total = F.sum("n")
    return counts.groupBy(*by).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


def chunk_profile(points: DataFrame, key: str = KEY) -> DataFrame:
    """A row per series: n, min, max, variance, kurtosis (excess), lag1 to lag4 (correlation with the value so many
    points before), rising (share of steps that don't fall), repeated (share of equal neighbours)."""
    w = _ordered(key)
    lags = points.select(key, "value", *[F.lag("value", k).over(w).alias(f"l{k}") for k in (1, 2, 3, 4)])
    step = F.col("l1").isNotNull()
    return lags.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.when(F.count("value") < 2, 0.0).otherwise(F.var_samp("value")).alias("variance"),
        F.kurtosis("value").alias("kurtosis"),
        *[F.corr("value", f"l{k}").alias(f"lag{k}") for k in (1, 2, 3, 4)],
        F.avg(F.when(step, (F.col("value") >= F.col("l1")).cast("double"))).alias("rising"),
        F.avg(F.when(step, (F.col("value") == F.col("l1")).cast("double"))).alias("repeated"),
    )


def _bits(values) -> np.ndarray:
    return np.asarray(values, dtype="<f8").view("<u8")


def xor_delta(value: Column, before: Column) -> Column:
    """The XOR of the bits of two doubles, as a long; null if either is. Spark has no cast of a double to its bits."""

    @F.pandas_udf("long")
    def xored(a, b):
        import pandas as pd

        ok = a.notna() & b.notna()
        x = (_bits(a.fillna(0.0)) ^ _bits(b.fillna(0.0))).view("<i8")
        return pd.Series(x, index=a.index).where(ok).astype("Int64")

    return xored(value, before)


def xor_deltas(points: DataFrame, key: str = KEY) -> DataFrame:
    """key, ts, seq, xor, leading, trailing: the XOR of neighbours and its zero bits (64 both where equal)."""
    w = _ordered(key)
    x = points.withColumn("before", F.lag("value").over(w)).where("before is not null and value is not null").withColumn("xor", xor_delta(F.col("value"), F.col("before")))
    bits = F.lpad(F.bin("xor"), 64, "0")
    leading = F.length(F.regexp_extract(bits, "^(0*)", 1))
    trailing = F.length(F.regexp_extract(bits, "(0*)$", 1))
    return x.select(key, "ts", "seq", "xor", leading.cast("long").alias("leading"), trailing.cast("long").alias("trailing"))


def xor_stats(points: DataFrame, key: str = KEY) -> DataFrame:
    """By key: n (steps), equal (steps without change), leading and trailing (mean zero bits), most_bits (the longest
    stretch from first to last set bit)."""
    x = xor_deltas(points, key)
    bits = F.when(F.col("xor") == 0, 0).otherwise(64 - F.col("leading") - F.col("trailing"))
    return x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("xor") == 0).alias("equal"), F.avg("leading").alias("leading"), F.avg("trailing").alias("trailing"), F.max(bits).cast("long").alias("most_bits"))


def steps(points: DataFrame, digits: int, *by: str) -> DataFrame:
    """by..., unscaled (values that `digits` decimals don't hold), step: the greatest common divisor of the others as
    whole numbers of the last digit, from partial results."""
    whole = F.when(F.round("value", digits) == F.col("value"), F.abs(F.round(F.col("value") * 10**digits)).cast("long"))

    @F.pandas_udf("long", functionType=F.PandasUDFType.GROUPED_AGG)
    def divisor(values):
        return int(np.gcd.reduce(np.array([x for x in values if x == x], np.int64)))

    rows = points.select(*by, whole.alias("c"))
    distinct = rows.where("c is not null").groupBy(*by, F.pmod(F.xxhash64("c"), F.lit(64)).alias("__part")).agg(divisor("c").alias("c"))
    found = distinct.groupBy(*by).agg(divisor("c").alias("step"))
    return rows.groupBy(*by).agg(F.count_if(F.col("c").isNull()).alias("unscaled")).join(found, list(by), "left")


def _whole_chunks(batches):
    """Sorted batches (key, day, ...) as tables that end where a chunk ends."""
    import pyarrow as pa

    def starts(t) -> np.ndarray:
        key = t.column(0).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        day = t.column(1).fill_null(-(1 << 62)).to_numpy()
        return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (day[1:] != day[:-1])]))

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        if held and len(starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), new.slice(0, 1)]))) == 2:
            whole, held = pa.concat_tables(held), []
            yield whole, starts(whole)
        last = int(starts(new)[-1])
        if last:
            whole = pa.concat_tables([*held, new.slice(0, last)])
            yield whole, starts(whole)
            held = []
        held.append(new.slice(last))
    if held:
        whole = pa.concat_tables(held)
        yield whole, starts(whole)


def coded(points: DataFrame, key: str = KEY) -> DataFrame:
    """By key and day, the chunk of a series: n, codec (of the fewest bytes), bytes, same_values and same_times: how many
    come back from every codec bit by bit. A missing value is NaN there, which no point has; points without a time have no
    day. A chunk is in a task's memory, so a day of a series bounds it; the chunks of a batch are coded together."""
    from ..functions import codecs

    names = sorted(codecs.CHUNKED)

    def run(batches):
        import pyarrow as pa

        for t, first in _whole_chunks(batches):
            starts = np.append(first, t.num_rows)
            us, values = t.column("us").fill_null(0).to_numpy(), t.column("value").to_numpy().astype("<f8")
            same, sizes = np.ones(len(values), bool), []
            for name in names:
                encode, decode = codecs.CHUNKED[name]
                data, ends = encode(values, starts)
                same &= _bits(decode(data, ends)) == _bits(values)
                sizes.append(np.diff(ends))
            times = codecs.times_unchunked(*codecs.times_chunks(us, starts)) == us
            # The first by name of the shortest.
            codec = np.argmin(sizes, axis=0)
            cols = [np.diff(starts), pa.array(names).take(pa.array(codec)), np.min(sizes, axis=0), *[np.add.reduceat(x.astype(np.int64), first) for x in (same, times)]]
            head = t.select([0, 1]).take(pa.array(first)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[head.column(i).combine_chunks() for i in (0, 1)], *[pa.array(c) for c in cols]], names=[key, "day", "n", "codec", "bytes", "same_values", "same_times"])

    rows = points.select(key, F.floor(micros() / 86_400_000_000).alias("day"), micros().alias("us"), "seq", "value")
    rows = rows.repartition(key, "day").sortWithinPartitions(key, "day", "us", "seq").drop("seq")
    return rows.mapInArrow(run, f"{key} string, day long, n long, codec string, bytes long, same_values long, same_times long")


def xor_encode(values: np.ndarray) -> np.ndarray:
    """The bits of the first value, then the XOR of each value with the one before."""
    b = _bits(values)
    return np.concatenate([b[:1], b[1:] ^ b[:-1]])


def xor_decode(coded: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.accumulate(np.asarray(coded, "<u8")).view("<f8")
