"""The queries of the operators of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import audio, decontam, license_scan, minhash, mixing, quality, records, secret_scan, sharding, suffix_dedup
from strata.llm.near_dup_sql import near_dup_sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sampled_splitters": lambda s, d: sharding.shard_digest(_docs(s, d)),
        "op2_audio_features": lambda s, d: audio.audio_digest(_docs(s, d)),
        "op3_hierarchical_bayes": lambda s, d: quality.quality_digest(_docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op4_minhash_components": lambda s, d: minhash.near_duplicates(_docs(s, d), minhash.MinHashParams(words=3, percent=85)),
        "op5_entropy_secrets": lambda s, d: secret_scan.secret_digest(_docs(s, d)),
        "op6_license_diagonals": lambda s, d: license_scan.license_digest(_docs(s, d)),
        "op7_framed_records": lambda s, d: records.records_digest(_docs(s, d), tokenizer_file("byte_bpe_50k.json")),
        "op8_difference_cover": lambda s, d: suffix_dedup.repeats_digest(_docs(s, d)),
        "op9_weighted_fair_queueing": lambda s, d: mixing.mix_digest(_docs(s, d)),
        "op10_bm25_block_max": lambda s, d: decontam.benchmark_hits(_docs(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_components": near_dup_sql(3, 85), "op9_weighted_fair_queueing": mixing.MIX_SQL}
