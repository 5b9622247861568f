"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import audio, html_text, langid, mixing, packing, quality, secrets, simhash, token_counts, token_files
from parlance.llm._common import read_table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; it is read there, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read_table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("draw")


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digested(audio.stored_recordings(read_table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_secret_scan, op3_simhash_dedup, op4_source_mix, op5_sequence_packing, op6_audio_features, op7_quality_rules, op8_main_text, op9_token_orc, op10_token_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mix": mixing.ORACLE_SQL}
