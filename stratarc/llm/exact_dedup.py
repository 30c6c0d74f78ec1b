"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts count as equal when they are equal after every run of white space became one space; null counts as empty.
Each step groups only rows that the step before left in a group of two or more, and only survivors of length and
prefix are read in full for the SHA-256 that decides. Group tables are written before they are joined back, so
both sides of every join are plain shuffles whose skewed partitions Spark can split; groups themselves are built
by map-side aggregates, so a text that a third of all rows share is no more than one row per task.

Results: every input row gets one output row. Of equal texts the smallest doc_id stays (nulls last: a null stays only where
all ids of the group are null). Among repeated rows of the kept doc_id exactly one is marked kept. Empty and null
texts form one group. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import squeezed, written

#: Characters of the normalised text that the second step hashes.
PREFIX = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    text_sha256 is null for texts that length or prefix settled, unless digest_all asks for a digest of every row;
    it is then taken in the first scan, and the grouping still refines step by step.
    """
    normal = squeezed(F.col(text_col))
    based = docs.select(F.col(id_col).alias("doc_id"), normal.alias("normal"))
    keys = [F.octet_length("normal").cast("long").alias("len"), F.xxhash64(F.substring("normal", 1, PREFIX)).alias("prefix")]
    digest = F.sha2("normal", 256).alias("sha")
    slim = written(based.select("doc_id", *keys, *([digest] if digest_all else [])), "dedup-keys")

    lengths = slim.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len")
    # written, so that a length of very many rows is only ever split among tasks, not grouped in one
    long = written(slim.join(lengths, "len", "left_semi"), "dedup-lengths")
    prefixes = long.groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    prefixes = written(prefixes.select("len", "prefix"), "dedup-prefixes")
    if digest_all:
        survivors = slim.join(prefixes, ["len", "prefix"], "left_semi").select("doc_id", "len", "sha")
        settled = slim.join(prefixes, ["len", "prefix"], "left_anti").select("doc_id", "sha")
    else:
        again = based.select("doc_id", "normal", *keys).join(prefixes, ["len", "prefix"], "left_semi")
        survivors = written(again.select("doc_id", "len", digest), "dedup-survivors")
        settled = slim.join(prefixes, ["len", "prefix"], "left_anti").select("doc_id", F.lit(None).cast("string").alias("sha"))
    groups = written(survivors.groupBy("sha", "len").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")
    # rows that repeat doc_id and text are one row with a count until the end
    distinct = survivors.groupBy("sha", "doc_id").agg(F.count("*").alias("times"))
    distinct = written(distinct, "dedup-rows")
    joined = distinct.join(groups.drop("len"), "sha")
    turn = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    grouped = joined.select("doc_id", "keep_id", "group_size", "sha", turn.alias("turn"))
    grouped = grouped.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = settled.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return grouped.unionByName(alone)


def _key(column) -> list:
    """An id as two columns that join null to null."""
    return [F.coalesce(column.cast("string"), F.lit("")).alias("xd_id"), column.isNull().alias("xd_null")]


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() drops, with docs' own columns, whatever their names and types.

    Rows that share the kept doc_id and its normalised text are reduced to one, the smallest by its JSON. An id whose rows differ in text
    keeps each text that it is the keeper of.
    """
    id_ = ["xd_id", "xd_null"]
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count("*").alias("times")).where("times > stay")
    gone = written(gone.select(*_key(F.col("doc_id")), "stay"), "dedup-gone")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    named = docs.select(row, *_key(F.col(id_col)), F.col(text_col).alias("text"))
    clear = named.join(gone, id_, "left_anti").select("row")
    # ids that keep something and drop something repeat: decide by id and text
    several = named.join(gone.where("stay > 0").drop("stay"), id_).withColumn("xd_sha", F.sha2(squeezed(F.col("text")), 256))
    first = several.groupBy(*id_, "xd_sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    dropped = groups.groupBy(*_key(F.col("doc_id")), F.col("text_sha256").alias("xd_sha")).agg(F.max("kept").alias("kept")).where(~F.col("kept")).drop("kept")
    both = clear.unionByName(first.join(dropped, [*id_, "xd_sha"], "left_anti").select("row"))
    return both.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)
