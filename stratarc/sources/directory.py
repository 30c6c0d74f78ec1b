"""A directory tree as a Spark data source, and extraction back to a directory.

The scan lists names on the driver and reads contents in the tasks, so the folder has to be mounted on every machine. Links are not
followed; special files are skipped; the result does not depend on listing order, since every later step sorts.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratarc.functions.paths import link_is_safe

MOST_READ = 1 << 28
SCHEMA = "path string, type short, mode int, mtime_s long, mtime_ns int, size long, content binary, link_target string"


class _Names(InputPartition):
    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [r for r in options["path"].split(os.pathsep) if r]
        self.per_task, self.skip = int(options.get("files_per_task", "500")), set(filter(None, options.get("skip", "").split(os.pathsep)))

    def _walk(self) -> Iterator[tuple[str, str]]:
        for root in self.roots:
            root = root.rstrip("/")
            name = os.path.basename(os.path.abspath(root))
            todo = [(root, name)]
            while todo:
                full, rel = todo.pop()
                if os.path.abspath(full) in self.skip:
                    continue
                yield full, rel
                if stat.S_ISDIR(os.lstat(full).st_mode):
                    todo += [(os.path.join(full, n), f"{rel}/{n}") for n in sorted(os.listdir(full), reverse=True)]

    def partitions(self) -> list[InputPartition]:
        names = list(self._walk())
        seen: set[str] = set()
        for _, rel in names:
            if rel in seen:
                raise ValueError(f"path {rel!r} occurs twice")
            seen.add(rel)
        return [_Names(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [_Names([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for full, rel in partition.names:
            s = os.lstat(full)
            kind = 0 if stat.S_ISREG(s.st_mode) else 1 if stat.S_ISDIR(s.st_mode) else 2 if stat.S_ISLNK(s.st_mode) else None
            if kind is None:
                continue
            content = None
            if kind == 0:
                with open(full, "rb") as f:
                    content = f.read()
            yield (rel, kind, s.st_mode & 0o7777, s.st_mtime_ns // 1_000_000_000, s.st_mtime_ns % 1_000_000_000, len(content or b""), content, os.readlink(full) if kind == 2 else None)


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stratarc_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_directory(spark: SparkSession, *roots: str, skip: tuple[str, ...] = (), files_per_task: int = 500) -> DataFrame:
    spark.dataSource.register(DirectorySource)
    return spark.read.format("stratarc_directory").option("path", os.pathsep.join(roots)).option("skip", os.pathsep.join(map(os.path.abspath, skip))).option("files_per_task", files_per_task).load()


def read_ranges(ranges: DataFrame) -> DataFrame:
    """ranges (path, offset, length) with content: only those bytes are read. A range beyond the end of its file, or of more than MOST_READ bytes, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                with open(path, "rb") as f:
                    end = os.fstat(f.fileno()).st_size
                    if not 0 <= length <= MOST_READ or not 0 <= offset <= end - length:
                        raise ValueError(f"{path!r} has no {length} bytes at {offset}")
                    f.seek(offset)
                    data = f.read(length)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([offset]), pa.array([length]), pa.array([data], pa.binary())], names=["path", "offset", "length", "content"])

    plain = ranges.select("path", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    return plain.mapInArrow(run, "path string, offset long, length long, content binary")


def extract(entries: DataFrame, contents: DataFrame, target: str, force: bool = False, unsafe_links: bool = False) -> int:
    """Write entries below target: directories first, files in tasks in order of their first chunk, links after them, directory times deepest first.

    Existing files are an error unless forced; set-id bits are never restored; unsafe links are left out. Returns the number of files.
    """
    # files of one block are written next to each other; those without chunks come first
    chunk = F.coalesce(F.try_element_at("chunks", F.lit(1)), F.lit(0).cast("long")) if "chunks" in entries.columns else F.lit(0).cast("long")
    facts = entries.select("path", "type", "mode", "mtime_s", "mtime_ns", "link_target", chunk.alias("first_chunk"))
    dirs = facts.where("type = 1").withColumn("depth", F.size(F.split("path", "/")))
    os.makedirs(target, exist_ok=True)
    for row in dirs.orderBy("path").toLocalIterator():
        os.makedirs(os.path.join(target, row["path"]), mode=0o700, exist_ok=True)

    def write(rows) -> Iterator[int]:
        n = 0
        for row in rows:
            full = os.path.join(target, row["path"])
            if not force and os.path.lexists(full):
                raise FileExistsError(full)
            if row["content"] is None:
                raise ValueError(f"{row['path']!r} can't be read: damaged, or a wrong password")
            os.makedirs(os.path.dirname(full), exist_ok=True)
            part = f"{full}.partial-{os.getpid()}"
            with open(part, "wb") as f:
                f.write(bytes(row["content"]))
            os.chmod(part, row["mode"] & 0o777)
            os.utime(part, ns=(0, row["mtime_s"] * 1_000_000_000 + row["mtime_ns"]))
            os.replace(part, full)
            n += 1
        yield n

    files = facts.where("type = 0").join(contents.select("path", "content"), "path")
    if "chunks" in entries.columns:
        files = files.repartitionByRange("first_chunk", "path").sortWithinPartitions("first_chunk", "path")
    done = sum(files.rdd.mapPartitions(write).collect())  # one number per task
    links = facts.where("type = 2") if unsafe_links else facts.where("type = 2").where(link_is_safe(F.col("path"), F.col("link_target")))
    for row in links.toLocalIterator():
        full = os.path.join(target, row["path"])
        if force and os.path.lexists(full):
            os.unlink(full)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        os.symlink(row["link_target"], full)
    for row in dirs.orderBy(F.desc("depth")).toLocalIterator():
        full = os.path.join(target, row["path"])
        os.chmod(full, row["mode"] & 0o777)
        os.utime(full, ns=(0, row["mtime_s"] * 1_000_000_000 + row["mtime_ns"]))
    return done
