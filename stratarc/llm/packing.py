"""Best-fit packing of token sequences by patterns of few documents fitted with non-negative least squares.

1. Every text is tokenised once; documents longer than a sequence are cut into full pieces and a rest. Only piece
   lengths, places and checksums go on from here.
2. The histogram of lengths (as many counts as a sequence has tokens, whatever the corpus) goes to the driver. Patterns
   of one, two or three lengths that fill a sequence, or nearly, are enumerated; non-negative least squares finds
   repeat counts whose lengths add up to the histogram; they are rounded down, and never exceed what is there.
3. The residual is packed best fit decreasing on the histogram: the longest length left is completed with the longest that
   fits, again and again, and the pattern so found is repeated until one of its lengths runs out. So the whole plan has a few
   thousand patterns at any size of the corpus.
4. Each piece gets its rank among pieces of its length, from counts by (length, hash bucket) and ranks within a bucket, and
   looks its place up in the plan, which is broadcast: its size depends on the sequence length alone.

Results: null and empty texts give one piece, the end id alone. Repeated rows are separate pieces. Null doc_ids are
packed like others. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarc.llm.common import bucket_bits, id_hash, written
from stratarc.llm.tokens import WordEncoder, default_path, text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, most: int, end_id: int, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for whole in batches:
            for batch in text_slices(whole, "text", 2_000_000, "words"):
                ids, ends = encoder.of_texts(batch.column("text"))
                n = np.diff(np.concatenate([[0], ends])) + 1
                per = -(-n // most)
                doc = np.repeat(np.arange(len(n)), per)
                piece = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                start = piece * most
                length = np.minimum(most, n[doc] - start)
                last = (piece == per[doc] - 1).tolist()
                begin = (ends[doc] - (n[doc] - 1) + start).tolist()
                wide = memoryview(ids.astype("<u4").tobytes())
                end = np.array([end_id], "<u4").tobytes()
                crc = np.empty(len(doc), np.int64)
                for i, (b, k, z) in enumerate(zip(begin, length.tolist(), last, strict=True)):
                    crc[i] = zlib.crc32(end, zlib.crc32(wide[4 * b : 4 * (b + k - 1)])) if z else zlib.crc32(wide[4 * b : 4 * (b + k)])
                names = batch.column("doc_id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([names.cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def enumerate_patterns(lengths: np.ndarray, most: int, near: int = 3, middle: int = 24) -> list[tuple[int, ...]]:
    """Patterns of one to three of the given lengths that leave at most near tokens of a sequence free."""
    there = np.zeros(most + 1, bool)
    there[lengths] = True
    under = np.maximum.accumulate(np.where(there, np.arange(most + 1), 0))  # the largest length up to each size
    found: dict[tuple[int, ...], None] = {}
    for a in sorted(lengths.tolist(), reverse=True):
        if most - a <= near:
            found[(a,)] = None
        b = int(under[most - a])
        while b and most - a - b <= near:
            found[tuple(sorted((a, b), reverse=True))] = None
            b = int(under[b - 1])
        rest = most - a
        for b in sorted({int(under[x]) for x in np.linspace(rest / 2, rest - 1, middle).astype(int) if x > 0} - {0}, reverse=True):
            c = int(under[rest - b])
            if c and rest - b - c <= near:
                found[tuple(sorted((a, b, c), reverse=True))] = None
    return list(found)


def fit_counts(patterns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 8) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, by coordinate descent on the few entries per pattern."""
    left = counts.astype(float)
    x = np.zeros(len(patterns))
    shapes = []
    for p in patterns:
        lens, times = np.unique(p, return_counts=True)
        shapes.append((lens.tolist(), times.tolist(), float((times * times).sum())))
    values = left.tolist()
    for _ in range(sweeps):
        moved = 0.0
        for j, (lens, times, norm) in enumerate(shapes):
            step = sum(k * values[n] for n, k in zip(lens, times, strict=True)) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                for n, k in zip(lens, times, strict=True):
                    values[n] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan_sequences(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together exactly the given counts of each length (index)."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            plan.append((pattern, times))
            for n in pattern:
                left[n] -= times

    def room(pattern: tuple[int, ...]) -> int:
        lens, times = np.unique(pattern, return_counts=True)
        return int((left[lens] // times).min())

    patterns = enumerate_patterns(np.flatnonzero(left[1:]) + 1, most)
    for p, x in zip(patterns, fit_counts(patterns, left), strict=True):
        use(p, min(int(x), room(p)))
    while left.any():  # residuals, best fit decreasing
        free, pattern = most, []
        there = left.copy()
        while free:
            fits = np.flatnonzero(there[: free + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            pattern.append(n)
            there[n] -= 1
            free -= n
        use(tuple(pattern), room(tuple(pattern)))
    return plan


def plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, places in a sequence, offset of the first place)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for n in sorted(set(pattern), reverse=True):
            k = pattern.count(n)
            lo = rank.get(n, 0)
            rank[n] = lo + k * times
            rows.append((n, lo, rank[n], sequence, k, offset))
            offset += k * n
        sequence += times
    return rows


def pack(docs: DataFrame, most: int = 2048, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, most, end_id, tokenizer or default_path(), id_col, text_col), "pack-pieces")
    histogram = np.zeros(most + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # as many rows as a sequence has tokens, at most
        histogram[row["length"]] = row["count"]
    rows = plan_rows(plan_sequences(histogram, most))
    plan = spark.createDataFrame(rows, "length long, lo long, hi long, first long, k long, base long")
    bits = bucket_bits(int(histogram.sum()))
    hashed = cut.withColumn("h", id_hash(F.concat_ws(":", "doc_id", "piece"))).withColumn("bucket", F.shiftright("h", 60 - bits))
    sums = written(hashed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-sums")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pack-starts")
    inside = Window.partitionBy("length", "bucket").orderBy("h", "doc_id", "piece", "ids_crc32")
    ranked = hashed.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"]))
    nth = F.col("rank") - F.col("lo")
    sequence = F.col("first") + F.floor(nth / F.col("k"))
    offset = F.col("base") + (nth % F.col("k")) * ranked["length"]
    return placed.select("doc_id", "piece", "start", ranked["length"].alias("length"), "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
