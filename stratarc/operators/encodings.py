"""Column encodings of sorted catalogs, as differences to the row before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.functions.scalars import varint_length, zigzag
from stratarc.operators.ordered import previous, ranged, running


def shared_prefix(a: Column, b: Column) -> Column:
    """Bytes that two strings share at their start, by halving: paths have at most 4096 bytes."""
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    most = F.least(F.length(x), F.length(y)) / 2

    def step(at: Column, jump: Column) -> Column:
        to = at + jump
        n = (to * 2).cast("int")
        return F.when((to <= most) & (F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n)), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(12, -1, -1)]), F.lit(0), step)


def front_coded(entries: DataFrame) -> DataFrame:
    """path, shared (bytes shared with the path before), suffix_hex."""
    seen = previous(entries.select("path"), ["path"], F.col("path"), "before")
    shared = shared_prefix(F.coalesce("before", F.lit("")), F.col("path"))
    return seen.withColumn("shared", shared).select("path", "shared", F.lower(F.expr("substring(hex(encode(path, 'UTF-8')), shared * 2 + 1)")).alias("suffix_hex"))


def front_decoded(coded: DataFrame, order: list[str]) -> DataFrame:
    """coded (shared, suffix_hex) in the given order, with path: what front_coded() was made from.

    A path needs the one before it. Of a whole range of rows only two things matter to what follows: how many bytes of the path before the range are
    left in its last path, and what stands behind them; these are worked out per range first, and one row a range goes through the driver.
    """
    parts = ranged(coded, order)

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        kept, tail = 1 << 30, b""
        for shared, suffix in zip(rows["shared"].tolist(), map(bytes.fromhex, rows["suffix_hex"].tolist()), strict=True):
            tail = (tail[: shared - kept] if shared > kept else b"") + suffix
            kept = min(kept, shared)
        return pd.DataFrame({"rg_part": [rows["rg_part"].iloc[0]], "kept": [kept], "tail": [tail]})

    before, path = [], b""
    for r in parts.groupBy("rg_part").applyInPandas(last, "rg_part int, kept long, tail binary").orderBy("rg_part").collect():  # one row a range
        before.append((r["rg_part"], bytes(path)))
        path = path[: r["kept"]] + bytes(r["tail"])
    starts = coded.sparkSession.createDataFrame(before, "rg_part int, rg_before binary")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields) + ", path string"

    columns = coded.columns

    def decode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        path, out = rows["rg_before"].iloc[0], []
        for shared, suffix in zip(rows["shared"].tolist(), map(bytes.fromhex, rows["suffix_hex"].tolist()), strict=True):
            path = path[:shared] + suffix
            out.append(path.decode())
        return rows[columns].assign(path=out)

    return parts.join(F.broadcast(starts), "rg_part").groupBy("rg_part").applyInPandas(decode, schema)


def mtime_deltas(entries: DataFrame) -> DataFrame:
    """path, mtime_s, delta (the first from 0), bytes of its signed varint."""
    seen = previous(entries.select("path", "mtime_s"), ["path"], F.col("mtime_s"), "before")
    delta = F.col("mtime_s") - F.coalesce("before", F.lit(0))
    return seen.select("path", "mtime_s", delta.alias("delta")).withColumn("bytes", varint_length(zigzag(F.col("delta"))))


def mtimes_decoded(coded: DataFrame, order: list[str]) -> DataFrame:
    """coded (delta) in the given order, with mtime_s: the sum of all deltas so far."""
    return running(coded, order, F.col("delta"), "mtime_s").withColumn("mtime_s", F.col("mtime_s") + F.col("delta"))


def refs_decoded(coded: DataFrame, order: list[str]) -> DataFrame:
    """coded (delta) in the given order, with chunk_id: every reference is one more than the one before, and delta."""
    return running(coded, order, F.col("delta") + 1, "chunk_id").withColumn("chunk_id", F.col("chunk_id") + F.col("delta"))


def ref_deltas(refs: DataFrame) -> DataFrame:
    """path, ref_pos, chunk_id, delta to one more than the reference before, carried across files."""
    seen = previous(refs.select("path", "ref_pos", "chunk_id"), ["path", "ref_pos"], F.col("chunk_id"), "before")
    return seen.select("path", "ref_pos", "chunk_id", (F.col("chunk_id") - (F.coalesce("before", F.lit(-1)) + 1)).alias("delta"))


def access_sequence(refs: DataFrame) -> DataFrame:
    """A file's blocks in reading order, consecutive repeats dropped: path, step, block_id."""
    order = Window.partitionBy("path").orderBy("ref_pos")
    changed = F.coalesce(F.lag("block_id").over(order) != F.col("block_id"), F.lit(True))
    kept = refs.select("path", "ref_pos", "block_id", changed.alias("changed")).where("changed")
    return kept.select("path", (F.row_number().over(order) - 1).alias("step"), "block_id")
