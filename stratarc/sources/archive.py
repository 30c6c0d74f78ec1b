"""An archive as a folder of Parquet tables: create, open, select, read, verify.

Tables: entries (sorted by path, so that a point or prefix lookup prunes), refs, chunks, blocks (payload last) and meta, a single row with the format's
version, parameters and root hash, which covers all of them. With a password the first three are written as sealed parts, so neither names nor hashes of
contents can be read without it. An archive is written to a folder beside its own and renamed when it is whole; meta is written last.
Nothing is handed out unchecked: a payload that doesn't give its hash isn't decoded, and a file that doesn't give its own has no content.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratarc.functions import codecs, crypto
from stratarc.functions.classify import classified
from stratarc.functions.paths import basename, extension
from stratarc.functions.transforms import transformed
from stratarc.operators import rollup, trees
from stratarc.operators import verify as checks
from stratarc.operators.blocks import block_offsets, chunk_offsets, pack_blocks
from stratarc.operators.chunking import BITS, LEAST, MOST, chunked
from stratarc.operators.dedup import with_ids, without_dedup
from stratarc.operators.ordered import numbered
from stratarc.operators.reassemble import joined, reassembled
from stratarc.operators.scratch import written
from stratarc.operators.select import find, prefix_select

VERSION = 2
#: What a reader has to know to read an archive; others refuse it.
CRITICAL = frozenset({"sealed-index"})
SCHEMAS = {
    "entries": "path string, type short, mode int, mtime_s long, mtime_ns int, transform short, chunks array<long>, hash string, size long, link_target string",
    "refs": "path string, ref_pos int, chunk_id long, chunk_len long",
    "chunks": "chunk_id long, chunk_len long, chunk_hash string, block_id long, block_offset long",
}
#: Bytes of a block's own header and of an archive's, and of a slice that a trial takes.
FRAME, HEADER, SLICE = 16, 32, 65_536


class Options(NamedTuple):
    level: int = 7
    plan: tuple[int, ...] | None = None
    block_size: int | None = None
    least: int = LEAST
    bits: int = BITS
    most: int = MOST
    dedup: bool = True
    filters: bool = True
    hash_len: int = 32
    password: str | None = None
    signing_key: bytes | None = None
    dictionary: bytes | None = None
    creator: str = "stratarc"
    created: int = 0
    force: bool = False
    #: Called on the driver with a step's name and the bytes that it has done: files, chunks, blocks.
    progress: Callable[[str, int], None] | None = None


class EmptyInput(ValueError):
    """There is nothing to archive."""


def storage_order(files: DataFrame) -> list:
    """Sort keys: class, transform, size of programs only, extension, name, path."""
    return [F.col("class"), F.col("transform"), F.when(F.col("class") == 1, F.col("size")).otherwise(F.lit(0).cast("long")), extension(F.col("path")), basename(F.col("path")), F.col("path")]


def in_storage_order(files: DataFrame) -> DataFrame:
    """files with storage_pos from 0."""
    keys = [f"so_{i}" for i in range(6)]
    keyed = files.withColumns(dict(zip(keys, storage_order(files), strict=True)))
    return numbered(keyed, keys, "storage_pos").drop(*keys)


def create(files: DataFrame, path: str, options: Options = Options()) -> None:  # noqa: B008 - a constant
    """Write the archive of files (path, type, mode, mtime_s, mtime_ns, content, link_target) to path: all of it, or nothing if that fails.

    An archive that is there already is an error, unless forced; it is then replaced when the new one is whole.
    """
    spark = files.sparkSession
    store, there = _store(spark, path)
    if store.exists(there) and not options.force:
        raise FileExistsError(path)
    part = f"{path}.partial-{uuid.uuid4().hex[:8]}"
    try:
        _create(files, part, options)
        store.delete(there, True)
        if not store.rename(_store(spark, part)[1], there):
            raise OSError(f"can't rename {part} to {path}")
    except BaseException:
        store.delete(_store(spark, part)[1], True)
        raise


def _store(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it wants it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _sealed_rows(rows: DataFrame, name: str, key: bytes) -> DataFrame:
    """part, data: rows in Arrow's stream format, encrypted batch by batch."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["part", "data"])
            part += 1

    # counters above those of blocks, apart for each table
    base = (1 << 62) + (list(SCHEMAS).index(name) << 58)
    plain = written(rows.mapInArrow(packed, "part long, data binary"), f"archive-{name}")
    return plain.select("part", crypto.sealed(F.col("data"), key, F.col("part") + base, F.concat(F.lit(f"{name}|"), F.col("part").cast("string"))).alias("data"))


def _opened_rows(parts: DataFrame, name: str, key: bytes) -> DataFrame:
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                if not data.is_valid:
                    raise ValueError(f"{name} can't be opened: damaged")
                yield from pa.ipc.open_stream(data.as_buffer())

    return parts.select(crypto.opened(F.col("data"), key, F.concat(F.lit(f"{name}|"), F.col("part").cast("string"))).alias("data")).mapInArrow(unpacked, SCHEMAS[name])


def _hashed_index(blocks: DataFrame, tables: dict[str, DataFrame], sealed: bool) -> DataFrame:
    """(t, k, h) of everything that the root hash covers."""
    key = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    row = lambda t, k, columns: (t, k, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    kinds = [(blocks, row("blocks", key("block_id"), ["block_id", "codec", "raw_len", "stored_len", "file_offset", "encrypted", "hash", F.hex("frame").alias("frame")]))]
    if sealed:
        kinds += [(df, (t, key("part"), F.sha2("data", 256))) for t, df in tables.items()]
    else:
        names = {t: [f.split()[0] for f in s.split(", ")] for t, s in SCHEMAS.items()}
        keys = {"entries": F.col("path"), "refs": F.concat("path", F.lit("|"), key("ref_pos")), "chunks": key("chunk_id")}
        kinds += [(df, row(t, keys[t], names[t])) for t, df in tables.items()]
    out = None
    for df, (t, k, h) in kinds:
        one = df.select(F.lit(t).alias("t"), k.alias("k"), h.alias("h"))
        out = one if out is None else out.unionByName(one)
    return out


def frame(codec, encrypted, raw_len, stored_len):
    """A block's own header: two letters, codec, flags, raw length in 5 bytes, stored length in 7."""
    byte = lambda x, n: F.lpad(F.hex(x.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(F.lit("5342"), byte(codec, 1), byte(encrypted.cast("int"), 1), byte(raw_len, 5), byte(stored_len, 7)))


def parsed_frame(data):
    """struct<magic, codec, encrypted, flags, raw_len, stored_len> of a block's header; null if it has another length."""
    number = lambda a, n: F.conv(F.hex(F.substring(data, a + 1, n)), 16, 10).cast("long")
    flags = number(3, 1)
    out = F.struct(F.hex(F.substring(data, 1, 2)).alias("magic"), number(2, 1).cast("short").alias("codec"), (flags % 2 == 1).alias("encrypted"), flags.alias("flags"), number(4, 5).alias("raw_len"), number(9, 7).alias("stored_len"))
    return F.when(F.octet_length(data) == FRAME, out)


def _create(files: DataFrame, path: str, options: Options) -> None:
    spark = files.sparkSession
    if files.isEmpty():
        raise EmptyInput("nothing to archive")
    repeated = files.groupBy("path").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"path occurs twice: {repeated.first()['path']!r}")
    size = options.block_size or codecs.block_size(options.level)
    contents = classified(files.where("type = 0").withColumn("size", F.octet_length("content").cast("long")), options.filters)
    hashed = contents.withColumn("hash", F.substring(F.sha2("content", 256), 1, 2 * options.hash_len))
    done = transformed(F.col("transform"), F.col("content"))
    if options.filters:
        hashed = _best_program_transform(written(hashed, "archive-classified"), options)
    coded = hashed.where("transform <> 0").withColumn("t", done).withColumns({"transform": F.col("t.transform"), "content": F.col("t.data")}).drop("t")
    ready = hashed.where("transform = 0").unionByName(coded)
    ordered = written(in_storage_order(ready.select("path", "class", "transform", "size", "hash", "mode", "mtime_s", "mtime_ns", "content")), "archive-files")
    tell = lambda step, df, column: options.progress and options.progress(step, df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])
    tell("files", ordered, "size")
    refs = written(chunked(ordered.select("storage_pos", "content"), options.least, options.bits, options.most, True, "storage_pos").join(ordered.select("storage_pos", "path", "class"), "storage_pos"), "archive-refs")
    light = refs.drop("data").withColumn("store_group", F.col("class") == 2)
    order = ["storage_pos", "ref_pos"]
    chunks, linked = (with_ids if options.dedup else without_dedup)(light, order)
    packed = written(chunk_offsets(pack_blocks(chunks.select("chunk_id", "chunk_len", "chunk_hash", "store_group", "storage_pos", "ref_pos"), size)), "archive-chunks")
    tell("chunks", packed, "chunk_len")
    data = packed.join(refs.select("storage_pos", "ref_pos", "data"), order)
    raw = data.groupBy("block_id").agg(F.first("store_group").alias("store_group"), F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "data"))), lambda x: x["data"]).alias("parts"))
    raw = raw.select("block_id", "store_group", joined(F.col("parts")).alias("raw"))
    stored = raw.where("store_group").select("block_id", F.lit(0).cast("short").alias("codec"), F.octet_length("raw").cast("long").alias("raw_len"), F.col("raw").alias("payload"))
    tried = raw.where("NOT store_group").select("block_id", F.octet_length("raw").cast("long").alias("raw_len"), codecs.compressed(F.col("raw"), options.level, options.plan, options.dictionary).alias("c"))
    blocks = stored.unionByName(tried.select("block_id", F.col("c.codec").alias("codec"), "raw_len", F.col("c.payload").alias("payload")))
    salt = crypto.new_salt() if options.password is not None else None
    blocks = blocks.withColumn("encrypted", F.lit(salt is not None))
    if salt is not None:
        key = crypto.derive_key(options.password, salt)
        blocks = written(blocks, "archive-plain").withColumn("payload", crypto.sealed(F.col("payload"), key, F.col("block_id"), _header(blocks)))
    blocks = blocks.withColumns({"stored_len": F.octet_length("payload").cast("long"), "hash": F.sha2("payload", 256)})
    blocks = written(blocks, "archive-blocks")
    tell("blocks", blocks, "stored_len")
    blocks = blocks.withColumn("frame", frame(F.col("codec"), F.col("encrypted"), F.col("raw_len"), F.col("stored_len")))
    blocks = block_offsets(blocks).select("block_id", "codec", "raw_len", "stored_len", "file_offset", "encrypted", "hash", "frame", "payload")
    by_file = linked.groupBy("storage_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
    listed = ordered.drop("content").join(by_file, "storage_pos", "left").select("path", F.lit(0).cast("short").alias("type"), "mode", "mtime_s", "mtime_ns", "transform", F.coalesce("chunks", F.array().cast("array<long>")).alias("chunks"), "hash", "size", F.lit(None).cast("string").alias("link_target"))
    other = files.where("type <> 0").select("path", "type", "mode", "mtime_s", "mtime_ns", F.lit(0).cast("short").alias("transform"), F.array().cast("array<long>").alias("chunks"), F.lit(None).cast("string").alias("hash"), F.lit(0).cast("long").alias("size"), "link_target")
    entries = listed.unionByName(other).withColumn("mode", F.col("mode").bitwiseAND(0o7777))
    cast = lambda df, t: df.select(*[F.col(n).cast(k).alias(n) for n, k in (f.split(" ", 1) for f in SCHEMAS[t].split(", "))])
    tables = {"entries": cast(entries, "entries").repartitionByRange("path").sortWithinPartitions("path"), "refs": cast(linked, "refs"), "chunks": cast(packed, "chunks")}
    for name, table in tables.items():
        (table if salt is None else _sealed_rows(table, name, key)).write.parquet(f"{path}/{name}")
    blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    length = blocks.agg(F.max(F.col("file_offset") + F.col("stored_len") + FRAME)).first()[0] or HEADER
    meta = {"version": VERSION, "archive_id": uuid.uuid4().hex, "hash_len": options.hash_len, "created": options.created, "creator": options.creator, "block_size": size, "salt": salt.hex() if salt else None, "primed": options.dictionary is not None, "length": length, "critical": ["sealed-index"] if salt else []}
    if salt:
        check = F.base64(crypto.sealed(F.lit(salt), key, F.lit((1 << 62) - 1), F.lit("check")))
        meta["check"] = spark.range(1).select(check).first()[0]
    root = checks.root_hash(json.dumps(meta, sort_keys=True), _hashed_index(blocks, {t: spark.read.parquet(f"{path}/{t}") for t in tables}, salt is not None))
    signature = public = None
    if options.signing_key is not None:
        signer = crypto.Signer(spark)
        signature, public = signer.sign(options.signing_key[:32], root).hex(), options.signing_key[32:].hex()
    row = [(json.dumps(meta, sort_keys=True), root, signature, public)]
    spark.createDataFrame(row, "meta string, root_hash string, signature string, signer string").coalesce(1).write.parquet(f"{path}/meta")


def _best_program_transform(files: DataFrame, options: Options) -> DataFrame:
    """files with one transform for all x86-64 programs: of the two that there are, the one after which zstd takes fewer bytes for all of them together.

    Of each program three slices are tried: at its start, middle and end. Sets of less than a slice tell nothing and keep what they have.
    """
    programs = files.where("transform = 4")
    if (programs.agg(F.sum(F.octet_length("content"))).first()[0] or 0) < SLICE:
        return files
    slices = lambda c: F.concat(*[F.substring(c, at, F.lit(SLICE)) for at in (F.lit(1), (F.greatest(F.octet_length(c) - SLICE, F.lit(0)) / 2).cast("int") + 1, F.greatest(F.octet_length(c) - SLICE, F.lit(0)) + 1)])
    tried = programs.select(*[transformed(F.lit(t).cast("short"), F.col("content"))["data"].alias(f"d{t}") for t in (3, 4)])
    sizes = tried.select(*[F.octet_length(codecs.compressed(slices(F.col(f"d{t}")), 4, (codecs.ZSTD,))["payload"]).cast("long").alias(f"n{t}") for t in (3, 4)])
    total = sizes.agg(F.sum("n3").alias("n3"), F.sum("n4").alias("n4")).first()
    best = 3 if total["n3"] < total["n4"] else 4
    return files.withColumn("transform", F.when(F.col("transform") == 4, F.lit(best).cast("short")).otherwise(F.col("transform")))


def _header(blocks: DataFrame):
    """What a block's encryption is bound to."""
    return F.concat_ws("|", F.col("block_id").cast("string"), F.col("codec").cast("string"), F.col("raw_len").cast("string"))


class Archive:
    """An opened archive; its tables are lazy DataFrames."""

    def __init__(self, spark: SparkSession, path: str, password: str | None = None, dictionary: bytes | None = None, provider: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """provider: given the blocks' table, where blocks come from instead (a cache, another store), with the same columns; they are checked like any."""
        row = spark.read.parquet(f"{path}/meta").first()
        self.spark, self.path, self.meta_text, self.root, self.signature, self.signer = spark, path, row["meta"], row["root_hash"], row["signature"], row["signer"]
        self.meta = json.loads(self.meta_text)
        if self.meta["version"] != VERSION:
            raise ValueError(f"unknown version {self.meta['version']}")
        if unknown := set(self.meta["critical"]) - CRITICAL:
            raise ValueError(f"needs what this version doesn't know: {', '.join(sorted(unknown))}")
        table = spark.read.parquet(f"{path}/blocks")
        self.stored, self.parts = provider(table) if provider else table, {t: spark.read.parquet(f"{path}/{t}") for t in SCHEMAS}
        self.dictionary = dictionary
        self.key = None
        if self.meta["salt"] and password is not None:
            salt = bytes.fromhex(self.meta["salt"])
            self.key = crypto.derive_key(password, salt)
            check = spark.range(1).select(crypto.opened(F.unbase64(F.lit(self.meta["check"])), self.key, F.lit("check"))).first()[0]
            if check is None or bytes(check) != salt:
                raise ValueError("wrong password")

    def _table(self, name: str) -> DataFrame:
        if not self.encrypted:
            return self.parts[name]
        if self.key is None:
            raise PermissionError("the archive needs a password")
        return _opened_rows(self.parts[name], name, self.key)

    @property
    def entries(self) -> DataFrame:
        return self._table("entries")

    @property
    def refs(self) -> DataFrame:
        return self._table("refs")

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks")

    @property
    def encrypted(self) -> bool:
        return self.meta["salt"] is not None

    @property
    def blocks(self) -> DataFrame:
        """Blocks ready to decode; the payload is null where it doesn't give its hash."""
        whole = self.stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("hash"), F.col("payload")))
        if not self.encrypted:
            return whole
        if self.key is None:
            raise PermissionError("the archive needs a password")
        return whole.withColumn("payload", crypto.opened(F.col("payload"), self.key, _header(whole)))

    def find(self, path: str) -> DataFrame:
        return find(self.entries, path)

    def select(self, filters: list[str]) -> DataFrame:
        return prefix_select(self.entries, filters)

    def read(self, entries: DataFrame) -> DataFrame:
        """path, content, hash of the given entries' files."""
        return reassembled(entries, self.refs, self.chunks, self.blocks, self.dictionary)

    def cat(self, path: str) -> bytes:
        row = self.read(self.find(path)).first()
        if row is None:
            raise FileNotFoundError(path)
        if row["content"] is None:
            raise ValueError(f"{path!r} can't be read: damaged, or a wrong password")
        return bytes(row["content"])

    def listing(self) -> DataFrame:
        """Entries as text lines, one per path."""
        from stratarc.functions.scalars import civil, human, octal

        kind = F.element_at(F.array(F.lit("-"), F.lit("d"), F.lit("l")), F.col("type").cast("int") + 1)
        tail = F.when(F.col("type") == 2, F.concat(F.lit(" -> "), "link_target")).otherwise("")
        return self.entries.select("path", F.concat(kind, F.lit(" "), octal(F.col("mode")), F.lit(" "), F.lpad(human(F.col("size")), 12, " "), F.lit(" "), civil(F.col("mtime_s")), F.lit(" "), "path", tail).alias("line"))

    def listing_json(self) -> DataFrame:
        return self.entries.select("path", F.to_json(F.struct("path", "type", "mode", "mtime_s", "mtime_ns", "size", "hash", "link_target")).alias("json"))

    def info(self) -> dict:
        """Counts and sizes: entries by type, files by transform, blocks by codec, unique, logical and stored bytes, their ratio."""
        kinds = {r["type_name"]: (r["entries"], r["logical_bytes"]) for r in rollup.type_counts(self.entries).collect()}  # three kinds
        transforms = {r["transform"]: r["files"] for r in rollup.transform_histogram(self.entries).collect()}
        by_codec = {r["codec_name"]: {"blocks": r["blocks"], "raw_bytes": r["raw_bytes"], "stored_bytes": r["stored_bytes"]} for r in rollup.codec_rollup(self.block_list()).collect()}
        logical, stored = sum(n for _, n in kinds.values()), sum(c["stored_bytes"] for c in by_codec.values())
        unique = self.chunks.agg(F.coalesce(F.sum("chunk_len"), F.lit(0)), F.count("*")).first()
        return {
            "version": self.meta["version"], "archive_id": self.meta["archive_id"], "root_hash": self.root, "encrypted": self.encrypted, "signed": self.signature is not None, "length": self.meta["length"],
            **{f"{k}s" if k != "dir" else "dirs": kinds.get(k, (0, 0))[0] for k in ("file", "dir", "symlink")}, "logical_bytes": logical, "unique_bytes": unique[0], "chunks": unique[1],
            "blocks": sum(c["blocks"] for c in by_codec.values()), "codecs": by_codec, "transforms": transforms, "stored_bytes": stored, "ratio": stored / logical if logical else None,
        }

    def info_json(self) -> str:
        return json.dumps(self.info(), sort_keys=True)

    def block_list(self) -> DataFrame:
        """Blocks of the table with the codec that their own header names."""
        own = parsed_frame(F.col("frame"))
        return self.stored.select("block_id", own["codec"].alias("codec"), "raw_len", "stored_len", "file_offset", "encrypted")

    def verify_json(self, **options) -> str:
        found = self.verify(**options).groupBy("problem").agg(F.count("*").alias("bad"), F.slice(F.sort_array(F.collect_set("subject")), 1, 20).alias("subjects"))
        bad = {r["problem"]: {"bad": r["bad"], "first": r["subjects"]} for r in found.collect()}  # one row a kind of problem
        files = self.entries.where("type = 0").count()
        return json.dumps({"ok": not bad, "blocks_ok": self.stored.count() - bad.get("block_hash", {"bad": 0})["bad"], "files_ok": files - bad.get("file_hash", {"bad": 0})["bad"] if not bad.keys() - {"file_hash"} else 0, "problems": bad}, sort_keys=True)

    def verify(self, expected_signer: bytes | None = None, need_signature: bool = False) -> DataFrame:
        """problem, subject. Files are only read if all blocks are whole and can be opened."""
        problems = []
        if checks.root_hash(self.meta_text, _hashed_index(self.stored, self.parts, self.encrypted)) != self.root:
            problems.append(("root_hash", "index"))
        if self.signature is not None:
            if not crypto.Signer(self.spark).verify(bytes.fromhex(self.signer), self.root, bytes.fromhex(self.signature)):
                problems.append(("signature", self.signer))
        if expected_signer is not None and self.signer != expected_signer.hex() or need_signature and self.signature is None:
            problems.append(("signer", self.signer or "unsigned"))
        blocks = checks.bad_block_hashes(self.stored).select(F.lit("block_hash").alias("problem"), F.col("block_id").cast("string").alias("subject"))
        own = parsed_frame(F.col("frame"))
        framed = self.stored.select("block_id", F.when((own["magic"] == "5342") & (own["flags"] < 2) & (own["codec"] == F.col("codec")), own["raw_len"]).alias("raw_len"), own["stored_len"].alias("stored_len"), own["encrypted"].alias("encrypted"))
        frames = checks.frame_mismatches(framed, self.stored).select(F.lit("frame").alias("problem"), F.col("block_id").cast("string").alias("subject"))
        places = checks.misplaced_blocks(self.stored, block_offsets(self.stored.drop("file_offset", "payload"), HEADER, FRAME)).select(F.lit("block_offset").alias("problem"), F.col("block_id").cast("string").alias("subject"))
        length = self.stored.agg(F.max(F.col("file_offset") + F.col("stored_len") + FRAME)).first()[0] or HEADER
        if length != self.meta["length"]:
            problems.append(("length", str(length)))
        blocks = blocks.unionByName(frames).unionByName(places)
        if self.encrypted and self.key is None:
            # nothing more can be told without the password
            return written(blocks, "verify").unionByName(self.spark.createDataFrame(problems, "problem string, subject string"))
        if self.encrypted:
            # a damaged part is told here, since none of the checks on its rows can run
            for t, parts in self.parts.items():
                shut = crypto.opened(F.col("data"), self.key, F.concat(F.lit(f"{t}|"), F.col("part").cast("string"))).isNull()
                if shut_parts := [r["part"] for r in parts.where(shut).select("part").limit(100).collect()]:
                    problems += [(f"{t}_part", str(p)) for p in shut_parts]
            if any(p.endswith("_part") for p, _ in problems):
                return written(blocks, "verify").unionByName(self.spark.createDataFrame(problems, "problem string, subject string"))
        sums = checks.bad_block_sums(self.stored, self.chunks).select(F.lit("block_sum").alias("problem"), F.col("block_id").cast("string").alias("subject"))
        dangling = checks.dangling_refs(self.refs, self.chunks).select(F.lit("chunk_ref").alias("problem"), F.col("path").alias("subject"))
        entries = checks.bad_entries(self.entries).select(F.concat(F.lit("entry_"), "problem").alias("problem"), F.col("path").alias("subject"))
        nested = trees.nesting_violations(self.entries).select(F.lit("nesting").alias("problem"), F.col("path").alias("subject"))
        twice = checks.repeated_paths(self.entries).select(F.lit("path_repeated").alias("problem"), F.col("path").alias("subject"))
        found = written(blocks.unionByName(sums).unionByName(dangling).unionByName(entries).unionByName(nested).unionByName(twice), "verify")
        schema = "problem string, subject string"
        out = found.unionByName(self.spark.createDataFrame(problems, schema))
        if found.isEmpty() and (not self.encrypted or self.key is not None):
            bad = checks.bad_files(self.entries, self.read(self.entries), self.meta["hash_len"])
            out = out.unionByName(bad.select(F.lit("file_hash").alias("problem"), F.col("path").alias("subject")))
        return out
