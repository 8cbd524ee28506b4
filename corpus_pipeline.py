"""A corpus pipeline of the operators in ``caselane.llm``: each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselane.llm import exactdup, langid, mixing, packing, simhash
from caselane.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

LEAST_SCORE = 0.3  # a short text of one language still reaches this; below, no language stands out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or of no clear language go."""
    model = langid.train(docs.filter(~langid.held_out(docs["doc_id"])))
    return langid.accept(docs, model, LEAST_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exactdup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks for; copies are rows."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their token ids and places in sequences; copies differ in doc_row."""
    return packing.pack(docs, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

ORACLE_SQL = None  # language identification, fingerprints and subword packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
