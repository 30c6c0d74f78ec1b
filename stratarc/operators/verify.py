"""Integrity checks. Each returns the offending rows, so an empty table means that all is well."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.functions.paths import is_valid, target_is_valid
from stratarc.operators.ordered import previous


def bad_block_hashes(blocks: DataFrame) -> DataFrame:
    """Blocks whose payload doesn't give their hash."""
    return blocks.where(F.sha2("payload", 256) != F.col("hash")).select("block_id")


def bad_block_sums(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks whose chunks don't add up to raw_len, hold an empty one, or are missing on one side."""
    sums = chunks.groupBy("block_id").agg(F.sum("chunk_len").alias("total"), F.min("chunk_len").alias("least"))
    both = blocks.select("block_id", "raw_len").join(sums, "block_id", "full_outer")
    ok = (F.col("total") == F.col("raw_len")) & (F.col("least") > 0)
    return both.where(~F.coalesce(ok, F.lit(False))).select("block_id", "raw_len", "total")


def dangling_refs(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    return refs.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def orphan_chunks(chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """Chunks that no file refers to; legal, but worth knowing."""
    return chunks.join(refs.select("chunk_id").distinct(), "chunk_id", "left_anti")


def unsorted_paths(entries: DataFrame, order: str) -> DataFrame:
    """Entries whose path doesn't rise over that of the entry before, in the order of the named column."""
    seen = previous(entries.select(order, "path"), [order], F.col("path"), "before")
    return seen.where("before IS NOT NULL AND NOT before < path").select("path")


def bad_entries(entries: DataFrame) -> DataFrame:
    """path, problem."""
    problem = (
        F.when(~is_valid(F.col("path")), "path")
        .when(~F.col("type").between(0, 2), "type")
        .when(~F.col("transform").between(0, 4), "transform")
        .when(~F.col("mtime_ns").between(0, 999_999_999), "mtime_ns")
        .when((F.col("type") == 2) & ~F.coalesce(target_is_valid(F.col("link_target")), F.lit(False)), "link_target")
    )
    return entries.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def frame_mismatches(frames: DataFrame, table: DataFrame) -> DataFrame:
    """Blocks whose own header differs from the block table."""
    own = frames.select("block_id", F.struct("raw_len", "stored_len", "encrypted").alias("f"))
    listed = table.select("block_id", F.struct("raw_len", "stored_len", "encrypted").alias("t"))
    return own.join(listed, "block_id", "full_outer").where(~F.col("f").eqNullSafe(F.col("t"))).select("block_id")


def bad_files(entries: DataFrame, hashes: DataFrame, hash_len: int = 32) -> DataFrame:
    """Files whose content hash differs; nothing is checked where hashes were not kept."""
    if hash_len == 0:
        return entries.where(F.lit(False)).select("path")
    want = F.substring(F.col("hash"), 1, 2 * hash_len)
    both = entries.where("type = 0").select("path", want.alias("want")).join(hashes.select("path", F.substring("hash", 1, 2 * hash_len).alias("got")), "path", "left")
    return both.where(~F.col("want").eqNullSafe(F.col("got"))).select("path")


def repeated_paths(entries: DataFrame) -> DataFrame:
    """Paths that more than one entry has."""
    return entries.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")


def misplaced_blocks(blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """Blocks whose file_offset isn't where the blocks before end; placed: the same blocks with offsets worked out anew."""
    both = blocks.select("block_id", "file_offset").join(placed.select("block_id", F.col("file_offset").alias("place")), "block_id")
    return both.where(~F.col("file_offset").eqNullSafe(F.col("place"))).select("block_id")


#: Rows that are hashed together at most, in the mean; the levels of the hash tree follow from the number of rows.
TOGETHER = 4096


def root_hash(meta: str, index: DataFrame) -> str:
    """Hash over the header and the index (t, k, h): a tree over the leading digits of the keys' hashes.

    The number of groups grows with the rows, so no group grows; every further level takes three digits off, which makes groups of 4096.
    """
    rows, digits = index.count(), 0
    while rows > TOGETHER * 16**digits:
        digits += 1
    level = index.select(F.sha2(F.concat("t", F.lit("|"), "k"), 256).alias("g"), F.concat("t", F.lit("|"), "k", F.lit("="), "h").alias("row"))
    while True:
        level = level.groupBy(F.substring("g", 1, digits).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ";"), 256).alias("h"))
        if not digits:
            break
        level = level.select("g", F.concat("g", F.lit("="), "h").alias("row"))
        digits = max(0, digits - 3)
    found = level.first()
    return hashlib.sha256(f"{meta};{found['h'] if found else ''}".encode()).hexdigest()
