"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.llm import (
    embeddings,
    html_paths,
    licenses,
    mixing,
    oracle,
    packing,
    piece_bpe,
    prefix_trie,
    quality_net,
    rules,
    secrets,
    simhash,
    superkmers,
    whitening,
)
from verbarium.llm.common import make_importable, read_table

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return read_table(spark, sf_dir, name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "size", "source_size", "target", "taken"]
    return mixing.mix(_table(spark, sf_dir, "documents")).select(*names)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op3_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_pages(_table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.quality(_table(spark, sf_dir, "documents")).select(*names)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), "kept"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One pass: a second Python worker per task would count against the executor's memory.
    rows = piece_bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path(PIECES), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = [
    op1_mixing,
    op2_secrets,
    op3_quality_net,
    op4_html_paths,
    op5_licenses,
    op6_quality_rules,
    op7_substring_dedup,
    op8_simhash,
    op9_packing,
    op10_embeddings,
    op11_prefix_trie,
    op12_pieces,
    op13_whitening,
    pipeline,
]

ORACLE = oracle.STATEMENTS
