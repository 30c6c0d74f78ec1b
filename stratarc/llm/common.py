"""Shared helpers: scratch tables, byte-level word splitting, stable hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir; a local one only where that is unset and everything runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "stratarc-shared")
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratarc-{name}-{uuid.uuid4().hex[:12]}"


#: Most rows and bytes that go to a Python worker at once; whole texts and blocks are long rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds for the jobs run inside; the session's own settings come back after them."""
    before = {k: spark.conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables of written(), or paths, that nothing reads any more: neither a plan that is still to run nor one that may run again."""
    for table in tables:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table._scratch)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_heap(spark: SparkSession) -> None:
    """Have the executors' JVMs collect garbage, after which they give unused heap back to the system: a heap that one operator has grown otherwise stays while
    Python workers of the next need the memory. As many tasks run as there are cores, so on an idle cluster each executor gets some.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def words_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def squeezed(text: Column) -> Column:
    """Text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Unique words, the code of every word in order, and each text's end within the codes.

    Splits on the six ASCII white-space characters; null texts have no words.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    unique = coded.dictionary
    blank = pc.index(unique, pa.scalar("", unique.type)).as_py()
    ends = ends[1:] - ends[0]
    if blank >= 0:  # pieces before, between or after white space hold nothing
        real = codes != blank
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        codes = codes[real]
    return unique, codes, ends


def hash_words(unique: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    from xxhash import xxh3_64_intdigest

    n = len(unique)
    return np.fromiter((xxh3_64_intdigest(w) for w in unique.cast(pa.binary()).to_pylist()), np.uint64, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def id_hash(col: Column) -> Column:
    """60 bits of md5 of an id's text, as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def bucket_bits(rows: int) -> int:
    """Bits of bucket number so that buckets and rows per bucket both grow with the root of the rows."""
    return max(0, min(24, (max(rows, 1).bit_length() + 1) // 2 - 1))


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """An integer array as compressed byte planes; rising: of differences, for sorted values."""
    import zstandard

    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, dtype, rising: bool = False) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if rising else values


_libc = None
#: What modules keep in a worker from task to task, by name, and how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def frugal(needs: str = "") -> None:
    """Have this worker give memory back to the system, as it is kept for many tasks of many operators.

    By default both Arrow's pool and malloc keep what one task needed at its peak. Whatever another operator left for its next tasks goes as well, but for
    what this one needs.
    """
    global _libc
    for name, drop in KEPT.items():
        if name != needs:
            drop()
    if _libc is None:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            import ctypes

            _libc = ctypes.CDLL("libc.so.6")
            _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            _libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
            _libc.mallopt(-8, 2)  # M_ARENA_MAX
        except (OSError, AttributeError):  # another C library: nothing to set
            _libc = False
    if _libc:
        _libc.malloc_trim(0)
