"""The operators of this subpackage applied to whole tables, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, audit, caps, exact, jaccard, language, licenses, mixing, neighbours, oracles, packing, periodic, substring, toxicity
from ..session import ship
from .store import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(_table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"))


def op8_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.digest(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(_table(spark, sf_dir, "pages"), Scratch(spark, "op10"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.search(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark, "op12"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return periodic.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        op1_best_fit_packing, op2_ngram_jaccard, op3_mix_sources, op4_toxicity, op5_substring_dedup, op6_language_id,
        op7_additive_quantisation, op8_spherical_caps, op9_license_scan, op10_warc, op11_exact_top_k, op12_filter_audit,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": oracles.jaccard(), "op3_mix_sources": mixing.sql(), "op5_substring_dedup": oracles.substring(),
        "op8_spherical_caps": oracles.caps(), "op9_license_scan": oracles.licenses(), "op10_warc": oracles.archives(),
        "op11_exact_top_k": exact.sql(), "op12_filter_audit": audit.sql(),
    }
