"""A corpus pipeline: language ID, near-duplicate removal, mixing, tokenizing. Each stage's rows are written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonelake.llm import bpe, langid, minhash, mixing
from tonelake.llm.common import drop_written, tables, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are noise, or in none of the languages of the labelled rows."""
    return langid.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a balanced sample with tempered source shares."""
    return mixing.keep_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with offsets, and whether decoding them gives the text."""
    return bpe.encode(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", remove_near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: The stages' models, hashes and random choices are not SQL's: tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are a written table; what earlier stages wrote is deleted as soon as the next table is there. The last stage's result reads the last table."""
    before = set(tables(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            drop_written(spark, [p for p in tables(spark) if p not in before][:-1])  # the last is this one
    return docs
