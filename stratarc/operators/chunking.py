"""Content-defined chunking.

A byte b is hashed to g(b) = (b + 1) * 40503 mod 2^16; the rolling value after byte t is the sum of g over the last 16 bytes,
each weighed by two to the power of its age, mod 2^16. A cut may follow t when the value's top ``bits`` bits are zero and 16 bytes have been
seen. A chunk ends at the first such place at or beyond ``least`` bytes, at ``most`` bytes otherwise, or at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16
#: Production sizes; callers with small files pass smaller ones.
LEAST, BITS, MOST = 16 << 10, 16, 256 << 10
_G = ((np.arange(256, dtype=np.uint32) + 1) * 40503).astype(np.uint16)


def candidates(data: np.ndarray, bits: int) -> np.ndarray:
    """Ends of chunks that the rolling value allows."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    g = _G[data]
    h = g[WINDOW - 1 :].copy()
    for age in range(1, WINDOW):
        h += g[WINDOW - 1 - age : len(g) - age] << np.uint16(age)
    return np.flatnonzero(h < (1 << (16 - bits)) if bits < 16 else h == 0) + WINDOW


def cuts(data: bytes, least: int, bits: int, most: int) -> list[int]:
    """Ends of all chunks."""
    n, out, start = len(data), [], 0
    ends = candidates(np.frombuffer(data, np.uint8), bits)
    while start < n:
        at = np.searchsorted(ends, start + least)
        end = int(ends[at]) if at < len(ends) else n
        start = min(end, start + most, n)
        out.append(start)
    return out


def streamed(read: Callable[[int], bytes], least: int, bits: int, most: int, buffer: int = 8 << 20) -> Iterator[bytes]:
    """The chunks that cuts() makes of everything that read(n) returns until it returns nothing, with no more than buffer + most bytes held."""
    held = before = b""
    while True:
        more = read(buffer)
        held += more
        # the rolling value looks back beyond what is held
        ends = candidates(np.frombuffer(before + held, np.uint8), bits) - len(before)
        start = 0
        while start < len(held) and (not more or len(held) - start >= most):
            at = np.searchsorted(ends, start + least)
            end = min(int(ends[at]) if at < len(ends) else len(held), start + most, len(held))
            yield held[start:end]
            start = end
        before, held = (before + held[:start])[1 - WINDOW :], held[start:]
        if not more:
            return


def chunked_paths(paths: DataFrame, least: int = LEAST, bits: int = BITS, most: int = MOST, with_data: bool = False, batch: int = 8 << 20) -> DataFrame:
    """chunked() for files of any size, by path (column path, below a folder that every machine sees): contents are read piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ref_pos", "offset", "chunk_len", "chunk_hash", *(["data"] if with_data else [])]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size, offset = [], 0, 0
                with open(path, "rb") as f:
                    for i, part in enumerate(streamed(f.read, least, bits, most)):
                        rows.append((path, i, offset, len(part), hashlib.sha256(part).hexdigest(), *([part] if with_data else [])))
                        offset, size = offset + len(part), size + (len(part) if with_data else 100)
                        if size >= batch:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    return paths.select("path").mapInArrow(run, "path string, ref_pos int, offset long, chunk_len long, chunk_hash string" + (", data binary" if with_data else ""))


def chunked(files: DataFrame, least: int = LEAST, bits: int = BITS, most: int = MOST, with_data: bool = False, key: str = "file_id") -> DataFrame:
    """One row per chunk: key, ref_pos, offset, chunk_len, chunk_hash, and data if asked for. Empty or null files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pos, offset, size, digest, data = [], [], [], [], [], []
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                for i, end in enumerate(cuts(content, least, bits, most) if content else []):
                    part = content[start:end]
                    keys.append(k)
                    pos.append(i)
                    offset.append(start)
                    size.append(end - start)
                    digest.append(hashlib.sha256(part).hexdigest())
                    if with_data:
                        data.append(part)
                    start = end
            columns = [pa.array(keys, batch.schema.field(0).type), pa.array(pos, pa.int32()), pa.array(offset, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string())]
            names = [key, "ref_pos", "offset", "chunk_len", "chunk_hash"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(data, pa.binary())] if with_data else [])], names=[*names, *(["data"] if with_data else [])])

    kind = dict(files.dtypes)[key]
    schema = f"{key} {kind}, ref_pos int, offset long, chunk_len long, chunk_hash string" + (", data binary" if with_data else "")
    return files.select(key, "content").mapInArrow(run, schema)


def fixed_chunks(files: DataFrame, size: int, key: str = "file_id") -> DataFrame:
    """Chunks of one size, in expressions only."""
    n = F.octet_length("content")
    each = files.where(n > 0).select(key, "content", F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("ref_pos", "offset"))
    part = F.substring(F.col("content"), F.col("offset") + 1, F.lit(size))
    return each.select(key, "ref_pos", F.col("offset").cast("long").alias("offset"), F.octet_length(part).cast("long").alias("chunk_len"), F.sha2(part, 256).alias("chunk_hash"))
