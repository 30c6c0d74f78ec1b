"""Greedy packing of ordered chunks into blocks, and offsets.

Packing keeps order: a block is closed when the next chunk would overfill it. Where the next block starts depends on all before, yet
from a given start the rest follows. So the chunks are cut into segments of many blocks; each segment works out, for every start that can come in from
before, where it leaves and how many blocks that takes; the driver links these few facts up segment by segment; then every segment numbers its blocks
from its true start. The result is exactly that of one scan. However many blocks there are, the segments are no more than SEGMENTS, so what the
driver sees is bounded by them and by the chunks that fit in a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarc.operators.ordered import running
from stratarc.operators.scratch import written


#: Segments at most; beyond it they hold more blocks each.
SEGMENTS = 2000
#: Entry of a segment in which no block starts.
NONE = 1 << 62


def greedy(lengths: list[int], size: int) -> list[int]:
    """Block numbers by one scan; what pack_blocks gives, for small inputs."""
    out, block, used = [], 0, 0
    for n in lengths:
        if used and used + n > size:
            block, used = block + 1, 0
        out.append(block)
        used += n
    return out


def _leaps(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """For a block that starts with row i, the row that the next one starts with."""
    return np.maximum(np.searchsorted(end, start + size, "right"), np.arange(len(start)) + 1)


def pack_blocks(chunks: DataFrame, size: int, segment_blocks: int = 256) -> DataFrame:
    """chunks (chunk_id, chunk_len, store_group) with block_id, numbered over both groups, store_group last."""
    placed = running(chunks.select("chunk_id", "chunk_len", "store_group"), ["store_group", "chunk_id"], F.col("chunk_len"), "start")
    placed = written(placed, "pack-starts")
    ends = placed.agg(F.max(F.col("start") + F.col("chunk_len"))).first()[0] or 0
    span = size * max(2, segment_blocks, -(-ends // (size * SEGMENTS)))
    bases = {r["store_group"]: r["b"] for r in placed.groupBy("store_group").agg(F.min("start").alias("b")).collect()}  # two groups
    base = F.lit(0).cast("long")
    for group, b in bases.items():
        base = F.when(F.col("store_group") == group, F.lit(b).cast("long")).otherwise(base)
    placed = placed.withColumn("start", F.col("start") - base).withColumn("end", F.col("start") + F.col("chunk_len"))
    segment = F.floor(F.col("start") / span).cast("long")
    # a segment also sees what starts within one block after it
    ahead = F.when((F.col("start") % span <= size) & (segment > 0), F.array(segment, segment - 1)).otherwise(F.array(segment))
    seen = written(placed.withColumn("segment", F.explode(ahead)), "pack-segments")

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id")
        s, e, seg = rows["start"].to_numpy(), rows["end"].to_numpy(), int(rows["segment"].iloc[0])
        own = int((s < (seg + 1) * span).sum())
        leap = _leaps(s, e, size)
        goes, count = np.zeros(own, np.int64), np.ones(own, np.int64)
        for i in range(own - 1, -1, -1):
            j = int(leap[i])
            goes[i], count[i] = (goes[j], count[j] + 1) if j < own else (e[j - 1], 1)
        big = np.concatenate([[True], (e - s)[: own - 1] > size]) if own else np.empty(0, bool)
        can = np.flatnonzero((s[:own] - seg * span <= size) | big)
        return pd.DataFrame({"store_group": rows["store_group"].iloc[0], "segment": seg, "start": s[can], "goes": goes[can], "blocks": count[can]})

    facts = seen.groupBy("store_group", "segment").applyInPandas(leave, "store_group boolean, segment long, start long, goes long, blocks long")
    # per segment, as many rows as chunks fit in a block
    known = {(r["store_group"], r["start"]): (r["segment"], r["goes"], r["blocks"]) for r in facts.collect()}
    entries, number = [], 0
    for group in sorted(bases):
        at = 0
        while (group, at) in known:
            seg, goes, n = known[group, at]
            entries.append((group, seg, at, number))
            at, number = goes, number + n
            # segments that the last block passes over, or ends in, start none
            entries += [(group, s, NONE, number) for s in range(seg + 1, goes // span + ((group, goes) not in known))]
    entry = placed.sparkSession.createDataFrame(entries, "store_group boolean, segment long, entry long, number long")

    def name(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id")
        s, e = rows["start"].to_numpy(), rows["end"].to_numpy()
        own = int((s < (int(rows["segment"].iloc[0]) + 1) * span).sum())
        leap, block = _leaps(s, e, size), int(rows["number"].iloc[0])
        out = np.full(len(s), block - 1, np.int64)
        i = int(np.searchsorted(s, rows["entry"].iloc[0]))
        while i < own:
            out[i : leap[i]] = block
            i, block = int(leap[i]), block + 1
        return pd.DataFrame({"chunk_id": rows["chunk_id"].to_numpy()[:own], "block_id": out[:own]})

    named = seen.join(F.broadcast(entry), ["store_group", "segment"], "left").groupBy("store_group", "segment").applyInPandas(_carry(name), "chunk_id long, block_id long")
    return chunks.join(named, "chunk_id")


def _carry(name):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["entry"].isna().all():
            raise ValueError("a chunk larger than a segment: raise segment_blocks")
        return name(rows)

    return run


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """Offset of each chunk in its block; a block's chunks are bounded by its size."""
    before = Window.partitionBy("block_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("block_offset", F.coalesce(F.sum("chunk_len").over(before), F.lit(0)))


def block_offsets(blocks: DataFrame, header: int = 32, frame: int = 16) -> DataFrame:
    """file_offset of each block: header, then all frames and payloads before it."""
    return running(blocks, ["block_id"], F.col("stored_len") + frame, "file_offset").withColumn("file_offset", F.col("file_offset") + header)
