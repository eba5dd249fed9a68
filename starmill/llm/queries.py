"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.functions.shared import shared_dir
from starmill.llm import (
    decontaminate,
    divergence,
    language_id,
    licenses,
    mixing,
    near_dup,
    quality,
    small_world,
    suffix_dedup,
    token_orc,
    topk,
    url_trust,
    whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_trust.judge(_table(spark, folder, "pages"))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, folder, "documents"))


def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("digest")


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).drop("source")


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.predict(docs, quality.fit(docs, _table(spark, folder, "labels")))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, folder, "documents"), near_dup.Rule(k=3, percent=85, rows=7))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_dir(spark, "token-orc")
    token_orc.write_tokens(
        _table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.digest(token_orc.read_tokens(spark, path))


def license_labels(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return small_world.near_duplicates(_table(spark, folder, "embeddings"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_host_trust": url_verdicts,
        "op2_language_codes": languages,
        "op3_suffix_dedup": repeated_strings,
        "op4_simhash_decontamination": benchmark_leaks,
        "op5_mixing": mix_sources,
        "op6_dual_tree_top_k": nearest_vectors,
        "op7_factorisation_machine": quality_scores,
        "op8_minhash_near_dup": near_duplicates,
        "op9_token_orc": token_files,
        "op10_license_scan": license_labels,
        "op11_whitening": whitened_vectors,
        "op12_divergence_cube": source_divergence,
        "op13_small_world": near_vectors,
    }
