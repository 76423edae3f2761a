"""URL filters: hashed host-suffix and path-prefix expressions against a rule list. DataFrame functions only.

A url gives one expression for each of its host suffixes and path prefixes of the lengths that some rule has,
so their number is bounded by the rule list. Expressions meet rules on the first 4 bytes of their SHA-256;
the full digests confirm, and the longest rule wins (of two as long the one with the longer host, then block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Rules up to this number are broadcast, as about 200 bytes each; more are joined by a salted shuffle.
BROADCAST_RULES = 20_000
SALTS = 32


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to
    `?`, `#` or the end. Both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    head = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(head, upper, lower), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, else null), verdict: one row per input
    row, repeated ones included. Where no rule fits, null urls included, the verdict is `default`."""
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = rules.select(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count(F.lit(1)).alias("n")).first()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = rules.select(F.concat("host", "path").alias("rule"), F.sha2(F.concat("host", F.lit("\x00"), "path"), 256).alias("digest"), "verdict", F.struct(F.length(F.concat("host", "path")).alias("whole"), F.length("host").alias("of_host")).alias("rank")).withColumn("short", F.substring("digest", 1, 8))
    suffixes = F.filter(F.array(*[F.when(F.size(F.split("host", r"\.")) >= n, F.substring_index("host", ".", -n)) for n in sorted(shape.labels)]).cast("array<string>"), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape.lengths)]).cast("array<string>"), lambda x: x.isNotNull())
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat(h, F.lit("\x00"), p), 256))))
    # The row number only tells repeated rows apart; it takes no part in any result.
    wide = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("own", F.explode_outer(digests)).withColumn("short", F.substring("own", 1, 8))
    if shape.n <= BROADCAST_RULES:
        joined = wide.join(F.broadcast(keyed), "short", "left")
    else:
        salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = wide.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    fits = F.col("own") == F.col("digest")
    best = joined.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(fits, F.struct("rank.whole", "rank.of_host", "verdict", "rule"))).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
