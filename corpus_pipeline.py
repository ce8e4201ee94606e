"""The corpus pipeline: quality rules, near-dedup, secrets, mixing and packing.

Each stage works on all that the one before it kept, written as Parquet in the shared scratch
area and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verbarium.llm import mixing, packing, rules, secrets, simhash
from verbarium.llm.common import make_importable, read_table, staged
from verbarium.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    make_importable(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    make_importable(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks: not, once or twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    make_importable(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mix),
    ("packing", pack),
]

# The random field and the fingerprints have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
