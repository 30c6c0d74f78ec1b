"""Files as rows, from tables with text."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarc.functions.paths import ancestors

COLUMNS = ["file_id", "path", "type", "mode", "mtime_s", "mtime_ns", "size", "content", "link_target"]


def _files(df: DataFrame, path, text, number) -> DataFrame:
    content = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return df.select(
        number.alias("file_id"), path.alias("path"), F.lit(0).cast("short").alias("type"), F.lit(0o644).alias("mode"),
        ((number * 7919) % 2_000_003 - 1_000_001).alias("mtime_s"), ((number * 1_000_003) % 1_000_000_000).cast("int").alias("mtime_ns"),
        F.octet_length(content).cast("long").alias("size"), content.alias("content"), F.lit(None).cast("string").alias("link_target"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _document_files(d: DataFrame) -> DataFrame:
    return _files(d, F.concat(F.lit("documents/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"), F.col("doc_id"))


def find_document(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The document file with exactly this path; its parts reach the scan as pushed filters on the table's own columns."""
    parts = path.split("/")
    if len(parts) != 4 or parts[0] != "documents" or not re.fullmatch(r"-?[0-9]+\.txt", parts[3]):
        return documents(spark, sf_dir).where("false")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where((F.col("doc_id") == int(parts[3][:-4])) & (F.col("lang") == parts[1]) & (F.col("source") == parts[2]))
    return _document_files(d).where(F.col("path") == path)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return _files(d, F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"), F.col("page_id") + 1_000_000_000)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("-"), "role", F.lit(".md"))
    return _files(d, path, F.col("text"), F.col("conv_id") * 1000 + F.col("turn") + 2_000_000_000)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _files(d, F.concat(F.lit("benchmark/"), F.col("item_id").cast("string"), F.lit(".txt")), F.col("text"), F.col("item_id") + 4_000_000_000)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for more in (pages, conversations, benchmark):
        out = out.unionByName(more(spark, sf_dir))
    return out


def with_parents(files: DataFrame) -> DataFrame:
    """files and the directories that they lie in and that are not listed."""
    parents = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().join(files.select("path"), "path", "left_anti")
    rows = parents.select(
        (-F.abs(F.xxhash64("path") % (1 << 40)) - 1).alias("file_id"), "path", F.lit(1).cast("short").alias("type"), F.lit(0o755).alias("mode"), F.lit(0).cast("long").alias("mtime_s"),
        F.lit(0).alias("mtime_ns"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("link_target"),
    )
    return files.select(*COLUMNS).unionByName(rows)


def synthetic(spark: SparkSession) -> DataFrame:
    """A small tree with programs, compressed data, links, copies and edge cases."""
    elf = lambda machine, body: b"\x7fELF\x02\x01\x01" + bytes(11) + machine.to_bytes(2, "little") + bytes(44) + body
    code = b"".join(b"\xe8" + (0x1000 - 12 * i).to_bytes(4, "little", signed=True) + b"\x48\x8b\x05" + (0x2000 - 12 * i).to_bytes(4, "little", signed=True) for i in range(300))
    text = "".join(f"line {i}\n" for i in range(1, 301)).encode()
    noise = b"".join(hashlib.sha256(i.to_bytes(4, "little")).digest() for i in range(157))[:5000]
    pattern = bytes((i * i * 31 + i * 7 + (i >> 3) * 13) % 251 for i in range(5000))
    rows = [
        ("src", 1, 0o755, 5, 1, None, None), ("src/text.txt", 0, 0o644, -3, 999_999_999, text, None), ("src/deep", 1, 0o755, 9, 0, None, None), ("src/deep/er", 1, 0o755, 9, 0, None, None),
        ("src/deep/er/copy.txt", 0, 0o644, 10, 5, text, None), ("src/prog64", 0, 0o755, 11, 0, elf(0x3E, code), None), ("src/prog32", 0, 0o755, 12, 0, elf(0x03, code), None),
        ("src/arm", 0, 0o755, 13, 0, elf(0xB7, b"".join((0x94000000 | (9000 - i)).to_bytes(4, "little") for i in range(400))), None), ("src/empty", 0, 0o600, 0, 0, b"", None), ("src/emptydir", 1, 0o700, 14, 0, None, None),
        ("src/한글/파일.txt", 0, 0o644, 15, 0, "안녕하세요\n".encode(), None), ("src/한글", 1, 0o755, 15, 0, None, None), ("src/deep/link", 2, 0o777, 16, 0, None, "../text.txt"), ("src/deep/escape", 2, 0o777, 17, 0, None, "/etc/passwd"),
        ("src/photo.jpg", 0, 0o644, 18, 0, b"\xff\xd8\xff\xe0" + noise, None), ("src/data.bin", 0, 0o644, 19, 0, noise, None), ("src/pack", 0, 0o644, 20, 0, b"\x1f\x8b\x08" + noise[:700], None),
        ("src/table.bin", 0, 0o644, 21, 0, pattern, None), ("src/short.bin", 0, 0o644, 22, 0, noise[:511], None),
    ]
    made = [(i, p, t, m, s, n, len(c or b""), c, link) for i, (p, t, m, s, n, c, link) in enumerate(rows)]
    return spark.createDataFrame(made, "file_id long, path string, type short, mode int, mtime_s long, mtime_ns int, size long, content binary, link_target string")
