"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, licenses, near_dedup, packing, pii, quality, sharding, substring_dedup, url_rules
from .store import save, temporary


def _kept(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query's result as a written table, without the intermediate ones."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with temporary(spark):
            return save(f(spark, sf_dir), f.__name__, keep=True)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_kept
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


@_kept
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("base", lambda s: s["rank"] == 0)), F.size(F.filter("base", lambda s: s["rank"] == 1)), F.size(F.filter("base", lambda s: s["rank"] == 2)), F.size(F.filter("base", lambda s: s["rank"] == 3))]
    return found.select("doc_id", *[n.cast("long").alias(f"n_{k}") for n, k in zip(count, pii.KINDS, strict=False)], F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


@_kept
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "class_id", "kept")


@_kept
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", "log_weight", "selected")


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), *tokenizer_files(), with_ids=False)


@_kept
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), licenses.TEMPLATES | licenses.SHORT)
    shown = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["first_word"].cast("string"), m["last_word"].cast("string"), m["matched"].cast("string")))
    return found.select("doc_id", "n_words", F.size("licenses").cast("long").alias("n_matches"), F.array_join(shown, ",").alias("matches"))


@_kept
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_kept
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_url_filters, op3_pii, op4_license_scan, op5_minhash_near_dedup, op6_quality_classifier, op7_packing, op8_substring_dedup, op9_embedding_near_dedup, op10_sharding)
}
