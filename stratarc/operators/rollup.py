"""Sizes and counts of an archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.functions.scalars import codec_name, type_name


def file_sizes(entries: DataFrame, refs: DataFrame) -> DataFrame:
    """path, size: the sum of a file's chunks, 0 without any."""
    sums = refs.groupBy("path").agg(F.sum("chunk_len").alias("size"))
    return entries.where("type = 0").select("path").join(sums, "path", "left").select("path", F.coalesce("size", F.lit(0)).alias("size"))


def codec_rollup(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(codec_name(F.col("codec")).alias("codec_name")).agg(F.count("*").alias("blocks"), F.sum("raw_len").alias("raw_bytes"), F.sum("stored_len").alias("stored_bytes")).orderBy("codec_name")


def type_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(type_name(F.col("type")).alias("type_name")).agg(F.count("*").alias("entries"), F.sum(F.coalesce("size", F.lit(0))).alias("logical_bytes"))


def transform_histogram(entries: DataFrame) -> DataFrame:
    return entries.where("type = 0").groupBy("transform").agg(F.count("*").alias("files"))


def create_stats(files: DataFrame, refs: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: files, dirs, links, input and unique bytes, bytes saved, chunks and blocks."""
    kinds = files.agg(F.count_if(F.col("type") == 0).alias("files"), F.count_if(F.col("type") == 1).alias("dirs"), F.count_if(F.col("type") == 2).alias("symlinks"))
    inputs = refs.agg(F.coalesce(F.sum("chunk_len"), F.lit(0)).alias("input_bytes"), F.count("*").alias("chunk_refs"))
    unique = chunks.agg(F.coalesce(F.sum("chunk_len"), F.lit(0)).alias("unique_bytes"), F.count("*").alias("unique_chunks"))
    packed = blocks.agg(F.count("*").alias("blocks"))
    # four one-row tables side by side
    one = kinds.withColumn("k", F.lit(0)).join(inputs.withColumn("k", F.lit(0)), "k").join(unique.withColumn("k", F.lit(0)), "k").join(packed.withColumn("k", F.lit(0)), "k").drop("k")
    return one.withColumn("saved_bytes", F.col("input_bytes") - F.col("unique_bytes"))


def size_report(classified: DataFrame) -> DataFrame:
    """Rollup of files and bytes by class and extension; totals have class -1 or extension '*'."""
    sums = classified.rollup("class", "ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.grouping("class").alias("c"), F.grouping("ext").alias("e"))
    return sums.select(F.when(F.col("c") == 1, -1).otherwise(F.col("class")).alias("class"), F.when(F.col("e") == 1, "*").otherwise(F.col("ext")).alias("ext"), "files", "bytes")
