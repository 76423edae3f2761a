"""The corpus pipeline: stages over the documents table, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, near_dedup, packing, pii, quality, store
from tidemark.llm.queries import tokenizer_files


def _good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.deduplicate(docs)


def _uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return pii.redact(docs)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training: the pieces of each document with their token ids."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("quality classifier", _good),
    ("MinHash near-dedup", _distinct),
    ("benchmark decontamination", _uncontaminated),
    ("PII", _redacted),
    ("packing", _packed),
]

#: SQL can't express the classifier, the sketches or the tokenizer; tests/llm hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
