"""Deduplication of chunks by content hash: the first occurrence in storage order keeps its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.operators.ordered import numbered
from stratarc.operators.scratch import written


def first_occurrences(refs: DataFrame, order: list[str]) -> DataFrame:
    """One row per chunk_hash: that of its first reference. A hash of any frequency is one row per task."""
    rest = [c for c in refs.columns if c != "chunk_hash"]
    first = refs.groupBy("chunk_hash").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select("chunk_hash", *[F.col(f"first.{c}").alias(c) for c in rest])


def with_ids(refs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks, refs): unique chunks numbered from 0 by first occurrence, and references with their chunk_id."""
    chunks = written(numbered(first_occurrences(refs, order), order, "chunk_id"), "chunks")
    return chunks, refs.join(chunks.select("chunk_hash", "chunk_id"), "chunk_hash")


def without_dedup(refs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every reference is a chunk of its own."""
    own = written(numbered(refs, order, "chunk_id"), "chunks")
    return own, own
