"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    block_join,
    decontamination,
    fuzzy_lines,
    merkle,
    mixing,
    personal_data,
    quality,
    secret_scan,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
    whitening,
)
from .common import table


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op2_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_join.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_report(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.document_secrets(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.good_documents(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_personal_data": (op1_personal_data, None),
    "op2_block_matrix_neighbours": (op2_block_matrix_neighbours, block_join.SQL),
    "op3_source_mixing": (op3_source_mixing, None),
    "op4_fuzzy_lines": (op4_fuzzy_lines, None),
    "op5_secret_scan": (op5_secret_scan, None),
    "op6_token_files": (op6_token_files, None),
    "op7_decontamination": (op7_decontamination, decontamination.SQL),
    "op8_toxicity_chain": (op8_toxicity_chain, None),
    "op9_simhash_near_duplicates": (op9_simhash_near_duplicates, None),
    "op10_quality": (op10_quality, None),
    "op11_substring_dedup": (op11_substring_dedup, substring_dedup.SQL),
    "op12_merkle_manifest": (op12_merkle_manifest, merkle.SQL),
    "op13_whitening": (op13_whitening, None),
}
