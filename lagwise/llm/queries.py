"""The queries of this subpackage over the documents table, and the SQL that some equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, lang_id, license_scan, line_dedup, media, mixing, packing, passages, quality, token_files
from .common import materialize
from .oracles import ORACLES


def tokenizer_path() -> str:
    """The public vocabulary that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(documents(spark, sf_dir))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    slim = materialize(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")), "sizes")
    return mixing.mix(slim, F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language(documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_license_scan, op2_substring_dedup, op3_source_mix, op4_quality_rules, op5_line_dedup, op6_token_files, op7_language_id, op8_jaccard_join, op9_packing, op10_media_columns]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
