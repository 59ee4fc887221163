"""Corpus pipeline over documents: five stages, each one operator of lodestone.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import jaccard, language, mixing, packing, substring
from lodestone.llm.store import Scratch

#: Language models, similarity joins and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go; null and empty texts have none."""
    return language.accept(docs, Scratch(spark, "stage-language"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id; texts without words stay."""
    return jaccard.keep_one(docs, Scratch(spark, "stage-jaccard"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that stand elsewhere too are cut from the texts; every document stays."""
    return substring.remove(docs, Scratch(spark, "stage-substring"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that the sources, a null one among them, come near their target weights."""
    return mixing.mix(docs, Scratch(spark, "stage-mixing"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents' pieces and their places in sequences of 2048; empty texts are the end token alone."""
    return packing.pack(docs, Scratch(spark, "stage-packing"), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder that the next stage reads.

    Rows that repeat are treated alike in every stage, null ids and sources are ordinary values, further columns of
    any name stay until packing, and an empty table gives no rows.  What only earlier stages needed is deleted.
    """
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, mark = None, Scratch.mark()
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.close_since(mark)
        if before:
            scratch.drop(before)
        before = name
    return docs
