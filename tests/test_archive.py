import hashlib
import io
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from stratarc.functions import paths, transforms
from stratarc.functions.crypto import Signer
from stratarc.operators import blocks as bl
from stratarc.sources import archive, views
from stratarc.sources.directory import extract, read_directory

SMALL = {"least": 256, "bits": 8, "most": 2048, "block_size": 4096}


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arc") / "a")
    archive.create(views.synthetic(spark), path, archive.Options(**SMALL))
    return archive.Archive(spark, path), path


def contents(df):
    return {r["path"]: bytes(r["content"]) for r in df.where("content IS NOT NULL").select("path", "content").collect()}


def test_round_trip(spark, plain):
    a, _ = plain
    assert contents(a.read(a.entries)) == contents(views.synthetic(spark))
    assert a.cat("src/empty") == b""
    assert a.verify().isEmpty()
    refs = a.refs.agg(F.sum("chunk_len")).first()[0]
    assert a.chunks.agg(F.sum("chunk_len")).first()[0] < refs  # the copy costs nothing
    assert {r["transform"] for r in a.entries.select("transform").distinct().collect()} == {0, 1, 2, 4}


def test_selection(plain):
    a, _ = plain
    assert {r["path"] for r in a.select(["src/deep/"]).collect()} == {"src/deep", "src/deep/er", "src/deep/er/copy.txt", "src/deep/link", "src/deep/escape"}
    with pytest.raises(ValueError):
        a.select(["src/dee"])
    with pytest.raises(FileNotFoundError):
        a.cat("nope")


def test_each_damaged_block_is_named(spark, plain):
    a, _ = plain
    for block in (0, a.stored.count() - 1):
        broken = F.overlay(F.col("payload"), F.lit(b"\xff\x00\xff"), F.lit(3), F.lit(3))
        damaged = a.stored.withColumn("payload", F.when(F.col("block_id") == block, broken).otherwise(F.col("payload")))
        keep, a.stored = a.stored, damaged
        found = {(r["problem"], r["subject"]) for r in a.verify().collect()}
        a.stored = keep
        assert found == {("block_hash", str(block))}


def test_encrypted_and_signed(spark, tmp_path):
    signer = Signer(spark)
    private, public = signer.new_keys()
    path = str(tmp_path / "e")
    archive.create(views.synthetic(spark), path, archive.Options(**SMALL, password="pä", signing_key=private + public, dedup=False))
    a = archive.Archive(spark, path, "pa\u0308")  # the same password in another normal form
    assert a.verify(public).isEmpty()
    assert contents(a.read(a.entries)) == contents(views.synthetic(spark))
    assert {r["problem"] for r in a.verify(bytes(32)).collect()} == {"signer"}
    with pytest.raises(ValueError):
        archive.Archive(spark, path, "wrong").cat("src/text.txt")
    with pytest.raises(PermissionError):
        archive.Archive(spark, path).cat("src/text.txt")
    signature = signer.sign(private, "00" * 32)
    assert signer.verify(public, "00" * 32, signature) and not signer.verify(public, "01" * 32, signature)
    assert not signer.verify(bytes([1] + [0] * 31), "00" * 32, signature)  # a key of small order


def test_directory_to_archive_and_back(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "d/e").mkdir(parents=True)
    (tree / "d/x.txt").write_text("hello\n" * 400)
    (tree / "d/e/y.bin").write_bytes(bytes(range(256)) * 9)
    (tree / "empty").write_bytes(b"")
    os.symlink("x.txt", tree / "d/ok")
    os.symlink("/etc/passwd", tree / "d/bad")
    os.chmod(tree / "d/x.txt", 0o640)
    files = read_directory(spark, str(tree))
    archive.create(files, str(tmp_path / "a"), archive.Options(**SMALL))
    a = archive.Archive(spark, str(tmp_path / "a"))
    out = tmp_path / "out"
    assert extract(a.entries, a.read(a.entries), str(out)) == 3
    back = out / "tree"
    assert (back / "d/x.txt").read_text() == "hello\n" * 400 and os.stat(back / "d/x.txt").st_mode & 0o777 == 0o640
    assert os.stat(back / "d/x.txt").st_mtime_ns == os.stat(tree / "d/x.txt").st_mtime_ns
    assert os.readlink(back / "d/ok") == "x.txt" and not os.path.lexists(back / "d/bad")
    with pytest.raises(Exception, match="FileExistsError"):
        extract(a.entries, a.read(a.entries), str(out))
    assert extract(a.entries, a.read(a.entries), str(out), force=True) == 3


def test_nothing_and_twice(spark, tmp_path):
    files = views.synthetic(spark)
    with pytest.raises(archive.EmptyInput):
        archive.create(files.where("false"), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        archive.create(files.union(files), str(tmp_path / "y"))


def test_paths(spark):
    bad = ["", "/", "/var/log", "logs/", "logs//today", ".", "x/.", "./x/y", "..", "x/..", "x/../y", "../../z", "z:/w", "note: one", "one\\two", "k/one\\two", "nul\0byte", "d/" * 2048 + "e", "q" * 4097]
    good = ["x", "x/y.z", "x/note: one", "...", "x/...y", "é/ü", "q" * 4096, " "]
    rows = spark.createDataFrame([(p,) for p in [*bad, *good]], "p string").withColumn("ok", paths.is_valid(F.col("p")))
    assert {r["p"] for r in rows.where("ok").collect()} == set(good)
    cases = [("a/l", "../t", True), ("l", "../t", False), ("a/b", "c/../../../x", False), ("a/b", "/x", False), ("a/b", "x\\y", False), ("a/b/c", "../../x", True)]
    links = spark.createDataFrame([c[:2] for c in cases], "p string, t string").select("p", "t", paths.link_is_safe(F.col("p"), F.col("t")).alias("ok"))
    assert {(r["p"], r["t"], r["ok"]) for r in links.collect()} == set(cases)


@pytest.mark.parametrize(("n", "size", "segment"), [(300, 1000, 2), (250, 300, 3), (1, 100, 4)])
def test_packing_is_that_of_one_scan(spark, n, size, segment):
    lengths = [(i * 7919) % 399 + 1 for i in range(n)]
    k = n * 2 // 3 + 1
    df = spark.createDataFrame([(i, x, i >= k) for i, x in enumerate(lengths)], "chunk_id long, chunk_len long, store_group boolean")
    got = {r["chunk_id"]: r["block_id"] for r in bl.pack_blocks(df, size, segment).collect()}
    a, b = bl.greedy(lengths[:k], size), bl.greedy(lengths[k:], size)
    assert [got[i] for i in range(n)] == a + [x + a[-1] + 1 for x in b]


def test_primed_archive(spark, tmp_path):
    priming = b"".join(sorted(bytes(c) for c in contents(views.synthetic(spark)).values()))[:4096]
    archive.create(views.synthetic(spark), str(tmp_path / "p"), archive.Options(**SMALL, dictionary=priming))
    a = archive.Archive(spark, str(tmp_path / "p"), dictionary=priming)
    assert not a.blocks.where("codec = 5").isEmpty() and a.verify().isEmpty()
    assert contents(a.read(a.entries)) == contents(views.synthetic(spark))


def _damaged(spark, src, dst, table, change):
    """A copy of the archive with one table rewritten."""
    shutil.copytree(src, dst)
    rows = change(spark.read.parquet(f"{src}/{table}")).collect()
    schema = spark.read.parquet(f"{src}/{table}").schema
    shutil.rmtree(f"{dst}/{table}")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{dst}/{table}")
    return str(dst)


def test_a_change_in_any_table_is_found(spark, tmp_path):
    plain, sealed = str(tmp_path / "plain"), str(tmp_path / "sealed")
    archive.create(views.synthetic(spark), plain, archive.Options(**SMALL, plan=()))
    archive.create(views.synthetic(spark), sealed, archive.Options(**SMALL, password="pw"))
    flip = lambda c: F.overlay(F.col(c), F.lit(b"\xff\x00\xff"), F.lit(3), F.lit(3))
    first = lambda key: F.col(key) == 0
    changes = {
        "entries": lambda d: d.withColumn("mtime_s", F.when(F.col("path") == "src/text.txt", F.col("mtime_s") + 1).otherwise(F.col("mtime_s"))),
        "refs": lambda d: d.withColumn("chunk_len", F.when((F.col("path") == "src/text.txt") & first("ref_pos"), F.col("chunk_len") + 1).otherwise(F.col("chunk_len"))),
        "chunks": lambda d: d.withColumn("chunk_hash", F.when(first("chunk_id"), F.lit("00")).otherwise(F.col("chunk_hash"))),
        "blocks": lambda d: d.withColumn("raw_len", F.when(first("block_id"), F.col("raw_len") + 1).otherwise(F.col("raw_len"))),
    }
    for t, change in changes.items():
        a = archive.Archive(spark, _damaged(spark, plain, tmp_path / f"p-{t}", t, change))
        assert "root_hash" in {r["problem"] for r in a.verify().collect()}
    assert "frame" in {r["problem"] for r in a.verify().collect()} and json.loads(a.verify_json())["ok"] is False
    for t in ("entries", "refs", "chunks"):
        a = archive.Archive(spark, _damaged(spark, sealed, tmp_path / f"s-{t}", t, lambda d: d.withColumn("data", flip("data"))), "pw")
        assert {"root_hash", f"{t}_part"} <= {r["problem"] for r in a.verify().collect()}
    # what is damaged isn't handed out, even where nothing is encrypted or compressed
    a = archive.Archive(spark, _damaged(spark, plain, tmp_path / "p-payload", "blocks", lambda d: d.withColumn("payload", F.when(first("block_id"), flip("payload")).otherwise(F.col("payload")))))
    got = {r["path"]: r["content"] for r in a.read(a.entries).select("path", "content").collect()}
    whole = contents(views.synthetic(spark))
    assert None in got.values() and all(v is None or bytes(v) == whole[p] for p, v in got.items())
    lost = next(p for p, v in got.items() if v is None)
    with pytest.raises(ValueError):
        a.cat(lost)
    with pytest.raises(Exception, match="can't be read"):
        extract(a.entries, a.read(a.entries), str(tmp_path / "out"))


def test_names_are_hidden(spark, tmp_path):
    path = tmp_path / "e"
    archive.create(views.synthetic(spark), str(path), archive.Options(**SMALL, password="pw"))
    text = hashlib.sha256(contents(views.synthetic(spark))["src/text.txt"]).hexdigest().encode()
    for f in path.rglob("*.parquet"):
        assert b"text.txt" not in f.read_bytes() and text not in f.read_bytes()
    closed = archive.Archive(spark, str(path))
    assert closed.verify().isEmpty()  # blocks and the root hash need no password
    for table in ("entries", "refs", "chunks"):
        with pytest.raises(PermissionError):
            getattr(closed, table)
    a = archive.Archive(spark, str(path), "pw")
    info = a.info()
    assert info["encrypted"] and info["files"] == 12 and info["symlinks"] == 2 and info["logical_bytes"] == sum(map(len, contents(views.synthetic(spark)).values()))
    assert info["unique_bytes"] == sum(c["raw_bytes"] for c in info["codecs"].values()) < info["logical_bytes"] and json.loads(a.info_json()) == json.loads(json.dumps(info))
    assert json.loads(a.verify_json())["files_ok"] == 12


def test_all_or_nothing(spark, tmp_path):
    path, files = str(tmp_path / "a"), views.synthetic(spark)
    with pytest.raises(ValueError):
        archive.create(files.union(files), path)
    assert os.listdir(tmp_path) == []
    archive.create(files.where("path LIKE 'src/t%'"), path, archive.Options(**SMALL))
    with pytest.raises(FileExistsError):
        archive.create(files, path, archive.Options(**SMALL))
    assert archive.Archive(spark, path).entries.count() == 2
    archive.create(files, path, archive.Options(**SMALL, force=True))
    assert archive.Archive(spark, path).entries.count() == files.count() and os.listdir(tmp_path) == ["a"]


def test_root_hash_does_not_depend_on_partitions(spark):
    from stratarc.operators import verify

    rows = spark.range(20_000).select(F.lit("t").alias("t"), F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    one = verify.root_hash("m", rows)
    assert one == verify.root_hash("m", rows.repartition(7)) != verify.root_hash("m", rows.where("k <> '77'"))
    assert verify.root_hash("m", rows.where("false")) != verify.root_hash("n", rows.where("false"))


def test_programs_share_the_better_transform(spark):
    code = b"".join(b"\xe8" + (0x10000 - 40 * i).to_bytes(4, "little", signed=True) + b"\x48\x8b\x05" + (0x20000 - 40 * i).to_bytes(4, "little", signed=True) + bytes([i % 7] * 28) for i in range(3000))
    df = spark.createDataFrame([("a", 4, code), ("b", 4, code[:50_000]), ("c", 0, b"x")], "path string, transform int, content binary").withColumn("transform", F.col("transform").cast("short"))
    got = {r["path"]: r["transform"] for r in archive._best_program_transform(df, archive.Options()).collect()}
    sizes = {t: sum(len(archive.codecs.compress(_trial(transforms.apply(t, d)), (archive.codecs.ZSTD,), 9)[1]) for d in (code, code[:50_000])) for t in (3, 4)}
    best = 3 if sizes[3] < sizes[4] else 4
    assert got == {"a": best, "b": best, "c": 0}


def _trial(data):
    n = archive.SLICE
    middle, last = max(len(data) - n, 0) // 2, max(len(data) - n, 0)
    return data[:n] + data[middle : middle + n] + data[last : last + n]


def test_large_files_piece_by_piece(spark, tmp_path):
    from stratarc.operators.chunking import chunked_paths, cuts, streamed
    from stratarc.sources.directory import read_ranges

    data = random.Random(3).randbytes(300_000) + bytes(50_000) + b"tail" * 999
    for least, bits, most, buffer in ((256, 9, 4096, 1000), (17, 5, 70, 64), (1024, 14, 20_000, 7777)):
        f = io.BytesIO(data)
        parts = list(streamed(f.read, least, bits, most, buffer))
        assert b"".join(parts) == data
        ends = cuts(data, least, bits, most)
        assert [len(p) for p in parts] == [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert list(streamed(io.BytesIO(b"").read, 256, 9, 4096)) == []
    path = tmp_path / "big"
    path.write_bytes(data)
    got = chunked_paths(spark.createDataFrame([(str(path),)], "path string"), 256, 9, 4096, True, 5000).orderBy("ref_pos").collect()
    assert b"".join(bytes(r["data"]) for r in got) == data and [r["offset"] + r["chunk_len"] for r in got] == cuts(data, 256, 9, 4096)
    asked = [(str(path), 0, 10), (str(path), len(data) - 4, 4), (str(path), 300_000, 0)]
    found = {(r["offset"], r["length"]): bytes(r["content"]) for r in read_ranges(spark.createDataFrame(asked, "path string, offset long, length long")).collect()}
    assert found == {(o, n): data[o : o + n] for _, o, n in asked}
    with pytest.raises(Exception, match="has no 5 bytes"):
        read_ranges(spark.createDataFrame([(str(path), len(data) - 4, 5)], "path string, offset long, length long")).collect()


def test_keys_from_files(tmp_path):
    from stratarc.functions.crypto import read_key

    (tmp_path / "k").write_text("  " + "ab" * 32 + "\n")
    assert read_key(str(tmp_path / "k"), 32) == read_key("AB" * 32, 32) == bytes([0xAB] * 32)
    for bad in ("ab" * 31, "xy" * 32, "", str(tmp_path)):
        with pytest.raises(ValueError):
            read_key(bad, 32)


def test_progress_provider_and_tuning(spark, tmp_path):
    from stratarc.functions import codecs

    told = []
    files = views.synthetic(spark)
    archive.create(files, str(tmp_path / "a"), archive.Options(**SMALL, progress=lambda step, n: told.append((step, n))))
    sizes = {p: len(c) for p, c in contents(files).items()}
    assert [s for s, _ in told] == ["files", "chunks", "blocks"] and told[0][1] == sum(sizes.values()) > told[1][1] > told[2][1]
    asked = []
    a = archive.Archive(spark, str(tmp_path / "a"), provider=lambda table: asked.append(1) or table.repartition(3))
    assert asked and contents(a.read(a.entries)) == contents(files)
    rows = codecs.tune(files.where("type = 0"), (codecs.ZSTD, codecs.CONTEXT_FAST)).collect()
    assert all(r["whole"] and r["packed_bytes"] <= r["raw_bytes"] for r in rows)
    assert {r["codec"]: r["raw_bytes"] for r in rows if r["path"] is None} == dict.fromkeys(("zstd", "context-fast"), sum(sizes.values()))
