"""From raw documents to packed training sequences: five stages, each an operator of stratarc.llm.

Every stage gets the table that the stage before wrote and works on all its rows. All but the last return the columns of
documents; the last returns a row per packed piece.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratarc.llm import exact_dedup, minhash, mixing, packing, quality
from stratarc.llm.common import release_heap, written


def lean(stage: Callable) -> Callable:
    """The stage begins on executors that have given back what the stage before needed."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_heap(spark)
        return stage(spark, docs, sf_dir)

    return run


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@lean
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact(docs)


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.drop_near(docs, percent=80)


@lean
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in training order."""
    return mixing.training_order(docs).select(*docs.columns)


@lean
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]

#: The first stage is a trained model, which SQL can't express; tests/llm compares run()'s rows with pieces that
#: the tokenizers library makes of the mix's copies, and both dedup stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
