import re

import numpy as np
import pytest

from stratarc.llm import topk


def brute(rows, asked, k=20):
    """(query_id, rank, vec_id, score) by full comparison."""
    made = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            made.append((i, np.floor(64 * np.array(v, float)).astype(np.int64)))
    out = set()
    for i, q in made:
        if asked(i):
            scores = sorted((-int(q @ v), j) for j, v in made if j != i and len(v) == len(q))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 120)
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "QUERIES", 5)


def test_exact_on_a_table(spark, sf, small):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 20 = 0")).collect()}
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.collect()], lambda i: i % 20 == 0)


def test_odd_vectors(spark, small):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(70)] + [(200 + i, [0.5] * 6) for i in range(60)]  # many equal ones tie
    rows += [(20, None), (40, [1.0, None] + [0.0] * 4), (60, [float("nan")] * 6), (80, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (100, [1.0, 2.0]), (101, [3.0, -1.0]), (300, [])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    asked = df.where("vec_id % 20 = 0")
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, asked).collect()}
    assert got == {x for x in brute(plain, lambda i: i % 20 == 0)}
    assert topk.top_k(df.where("false"), asked.where("false")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    vectors = np.floor(64 * rng.normal(size=(500, 8)))
    order, lo, hi, centers, radii, left = topk.build_tree(vectors, 16)
    assert sorted(order.tolist()) == list(range(500))
    for a, b, c, r in zip(lo, hi, centers, radii, strict=True):
        assert (np.sqrt(((vectors[order[a:b]] - c) ** 2).sum(1)) <= r).all()
    leaves = sorted((a, b) for a, b, n in zip(lo, hi, left, strict=True) if n == 0)
    assert leaves[0][0] == 0 and leaves[-1][1] == 500 and all(x[1] == y[0] for x, y in zip(leaves, leaves[1:], strict=False))


def test_pipeline(spark):
    import corpus_pipeline
    from stratarc.llm.common import written

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left, counts = docs.columns, docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = left
        left = written(stage(spark, left, sf), "test-stage")
        counts.append(left.count())
        if i < 4:
            assert left.columns == columns
            assert left.join(before, "doc_id", "left_anti").isEmpty()
        if i == 1:  # exact dedup
            norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
            assert sorted(map(norm, left.collect())) == sorted({norm(r) for r in before.collect()})
        if i == 2:  # near dedup: what stays is no link of what stays, and what went has one
            from tests.llm.test_text_operators import brute_components

            want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 80)}
            assert {r["doc_id"] for r in left.collect()} == want
    assert counts[0] <= docs.count() and counts[4] >= counts[3] > 0
    assert corpus_pipeline.run(spark, sf).count() == counts[4]


def test_pipeline_rows(spark):
    import zlib
    from collections import Counter

    import corpus_pipeline
    from stratarc.llm import mixing, quality
    from stratarc.llm.common import written
    from stratarc.llm.tokens import default_path
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = left = spark.read.parquet(f"{sf}/documents.parquet")
    whole = set(map(tuple, docs.collect()))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        left = written(stage(spark, left, sf), "test-rows")
        assert set(map(tuple, left.collect())) <= whole
        if i == 0:
            scored = quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            assert sorted(r["doc_id"] for r in left.collect()) == sorted(r["doc_id"] for r in scored.where("accepted").collect())
    copies = {r["doc_id"]: r["mx_copies"] for r in mixing.mix_sources(left).collect()}
    tokenizer, want = Tokenizer.from_file(default_path()), Counter()
    for r in left.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[r["doc_id"], at // 2048, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += copies[r["doc_id"]]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("kind", ["odd", "empty", "blank"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    """Nulls, empty and blank texts, repeated rows and ids, very long texts, a source without words, and columns named like the operators' own."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    base = " ".join(f"word{i % 37}x{i % 11}" for i in range(300))
    rows = [
        (5, base, "en", "a"), (3, base.replace(" ", " \n\t"), "en", "a"), (9, base + " extra", "en", None), (4, None, None, "b"), (8, "", "fr", "b"), (2, " \n ", "fr", "b"), (7, "one two", "de", "c"), (7, "one two", "de", "c"),
        (None, "no id at all here", "en", "a"), (None, base, "en", "d"), (12, "x" * 300_000 + " " + "y, " * 200_000, "en", "a"), (13, "one two three four five", "es", None), (7, "another text under a used id", "de", "c"), (2**40, "\\" * 100_000, "en", "a"),
    ]
    rows = {"odd": rows, "empty": [], "blank": [(i, (None, "", " \n")[i % 3], "en", "s") for i in range(5)]}[kind]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["position", "mx_size", "mx_row", "xd_id", "xd_sha", "row", "nd_id", "kept", "component_id", "n_shingles", "y", "hash", "rank", "score", "piece", "length", "start", "sig", "rep"]
    df = df.withColumns({n: F.lit(i) for i, n in enumerate(names)}).withColumn("tags", F.create_map(F.lit("k"), "lang"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0), (8, 0, 0), (12, 1, 0), (7, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert sorted(after.columns) == sorted(docs.columns), name
        after.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    # every row that reached the last stage is packed whole, without gaps or overlaps
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 2048
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert sum(r["piece"] == 0 for r in out) == docs.count()
    if kind == "odd":
        assert {12, 2**40} & {r["doc_id"] for r in out} and docs.where("doc_id = 12").count() <= 3


def test_what_other_operators_left_goes_before_a_tokenizer_comes(monkeypatch):
    from stratarc.llm import common, tokens

    left, seen = ["model"], []
    monkeypatch.setitem(common.KEPT, "other", left.clear)
    monkeypatch.setattr(tokens.WordEncoder, "_by_path", {})
    monkeypatch.setattr(tokens.WordEncoder, "__init__", lambda self, path: seen.append(list(left)))
    tokens.WordEncoder.at("any")
    assert seen == [[]]


def test_stages_begin_on_executors_that_gave_heap_back(spark, monkeypatch):
    import corpus_pipeline
    from stratarc.llm.common import release_heap

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collections = lambda: sum(b.getCollectionCount() for b in beans())
    before = collections()
    release_heap(spark)
    assert collections() > before

    did = []
    monkeypatch.setattr(corpus_pipeline, "release_heap", lambda s: did.append("release"))
    for module, name in (("exact_dedup", "drop_exact"), ("minhash", "drop_near"), ("packing", "pack")):
        monkeypatch.setattr(getattr(corpus_pipeline, module), name, lambda docs, **_: did.append("work"))
    for k in (1, 2, 4):
        corpus_pipeline.STAGES[k][1](spark, None, "")
    assert did == ["release", "work"] * 3


def test_token_binary_makes_one_frame_of_a_partition_and_skips_the_normaliser_for_plain_letters():
    from stratarc.llm import token_binary
    from stratarc.llm.tokens import WordEncoder, default_path

    assert token_binary.FRAME * 2.5 >= token_binary.PARTITION  # bytes an id
    encoder = WordEncoder(default_path())
    assert encoder.plain is not encoder.tokenizer
    stems = [w[:-4] for w in encoder.tokenizer.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha() and w[:-4].islower()][:5000]
    stems = [x.encode() for x in stems] + [a.encode() + b"qx" + b.encode() for a, b in zip(stems, stems[::-1], strict=True)]
    for plain, full in zip(encoder._of_letters(stems, encoder.plain), encoder._one_by_one(stems), strict=True):
        assert plain.tolist() == full.tolist()
