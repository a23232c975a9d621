"""Registered queries of the operators over documents, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit_packing,
    chosen_path_join,
    conversation_trie,
    embedding_whitening,
    license_scan,
    line_dedup,
    lz_fingerprints,
    minmax_dedup,
    oracle,
    ordinal_quality,
    ring_shards,
    secret_ledger,
    simhash_decontamination,
    substring_dedup,
)
from .common import documents


def vocabulary() -> str:
    """Where the public vocabulary file lies; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.quality_digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints.edit_digest(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_digest(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(documents(spark, sf_dir), vocabulary())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(documents(spark, sf_dir))


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path_join.classes(documents(spark, sf_dir))


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards.shard_digest(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.run_digest(documents(spark, sf_dir))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secret_digest(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_components(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def sql() -> dict[str, str]:
    return oracle.sql()
