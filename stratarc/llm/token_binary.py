"""Token ids of whole texts in a binary format, coded by the context-mixing range coder.

Documents are range-partitioned by doc_id; every partition becomes a shard of frames in ascending order. A row of the
written table is one frame: shard, frame, its ids' number, and the payload: a directory of doc_ids and id counts,
then the coded blocks (range_coder). The table is Parquet, so Spark's commit protocol and any store it reads work;
``payload`` holds the format itself, and concatenated payloads of a shard are a plain binary file.

Nulls: a null text is empty (its end id alone); null doc_ids stand first. Rows that repeat a doc_id keep an order by text hash.
An empty table gives an empty result. Only the named columns are read. Ids must fit in 16 bits; a larger vocabulary is
refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratarc.llm import range_coder
from stratarc.llm.common import scratch_path, small_batches, written
from stratarc.llm.tokens import WordEncoder, default_path, text_slices

#: Ids after which a frame ends with the document in hand: many blocks share what numpy's calls cost.
FRAME = 20_000_000
#: Text bytes of a partition, which are some 16 million ids and so make one frame; smaller ones keep the cores busy.
PARTITION, SMALLEST = 44_000_000, 4_000_000
#: Words that a worker keeps, and text bytes that it looks up at once: every look-up passes over all words kept.
KEEP, SLICE = 600_000, 8_000_000
#: Frames up to which their starts are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
SCHEMA = "shard int, frame int, n_ids long, payload binary"


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids with end_id after each, and each text's number of ids."""
    return np.insert(ids, ends, end_id), np.diff(np.concatenate([[0], ends])) + 1


def frame_payload(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = zlib.compress(null.tobytes() + np.diff(names, prepend=0).astype("<i8").tobytes() + sizes.astype("<u4").tobytes(), 6)
    return struct.pack("<4sIII", b"TIDF", len(doc_ids), len(head), zlib.crc32(head)) + head + range_coder.encode(ids)


def read_payload(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, sizes and ids of a frame; ValueError if it is damaged."""
    magic, n, n_head, crc = struct.unpack_from("<4sIII", payload)
    head = payload[16 : 16 + n_head]
    if magic != b"TIDF" or zlib.crc32(head) != crc:
        raise ValueError("damaged frame directory")
    head = zlib.decompress(head)
    null = np.frombuffer(head, np.uint8, n)
    names = np.cumsum(np.frombuffer(head, "<i8", n, n))
    sizes = np.frombuffer(head, "<u4", n, 9 * n).astype(np.int64)
    return [None if z else int(d) for d, z in zip(names, null, strict=True)], sizes, range_coder.decode(payload[16 + n_head :])


def write_ids(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode docs and write the frames to path."""
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(tokenizer, KEEP)
        if encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit in 16 bits")
        shard, frame = TaskContext.get().partitionId(), 0
        names, sizes, parts, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            payload = frame_payload(names, np.concatenate(sizes), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([frame], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "frame", "n_ids", "payload"])

        for whole in batches:
            for batch in text_slices(whole, "text", SLICE, "words"):
                ids, each = with_end(*encoder.of_texts(batch.column("text")), end_id)
                names += batch.column("doc_id").to_pylist()
                sizes.append(each)
                parts.append(ids)
                n += len(ids)
                if n >= FRAME:
                    yield out()
                    frame += 1
                    names, sizes, parts, n = [], [], [], 0
        if names:
            yield out()

    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        partitions = max(1, size // PARTITION, min(spark.sparkContext.defaultParallelism, size // SMALLEST))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    ranged = source.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    with small_batches(spark):
        ranged.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) ids of every document in the files."""
    frames = spark.read.schema(SCHEMA).parquet(path)
    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = frames.select("shard", "frame", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("frame_start")).join(shards, "shard")
    starts = starts.select("shard", "frame", (F.col("shard_start") + F.col("frame_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                names, sizes, ids = read_payload(payload.as_py())
                start = base + np.cumsum(sizes) - sizes
                at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at, at[1:], strict=False)]
                columns = [pa.array(names, pa.int64()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    few = frames.count() <= BROADCAST_ROWS  # 16 bytes a frame of about FRAME ids
    return written(frames.join(F.broadcast(starts) if few else starts, ["shard", "frame"]).select("base", "payload").mapInArrow(run, schema), "token-rows")


def op2_token_binary(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents, from the files."""
    path = scratch_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path, with_ids=False)
