import duckdb
import pytest

from stratarc.plans import catalog

SLOW = {"cdc_chunks", "cdc_dedup_savings"}  # their SQL takes long; cdc_chunks stands for both


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW - {"cdc_chunks"}])
def test_same_as_sql(spark, sf, con, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "stratarc"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "stratarc.llm" not in p.read_text()


def test_each_context_codec_is_run(spark, sf):
    coded = catalog._context_coded(spark, sf).select("fast.codec", "full.codec").collect()
    assert {tuple(r) for r in coded} == {(catalog.codecs.CONTEXT_FAST, catalog.codecs.CONTEXT)}


def test_human_sizes_round_halves_to_even(spark):
    sizes = [0, 1023, 1024, 1028, 1029, 1152, 1408, 1664, 1920, (1 << 20) - 1, 1 << 20, (1 << 20) + (1 << 17), 5 * (1 << 30) + (3 << 27), 1 << 40, (1 << 62) + 1]
    units = [(1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")]

    def plain(n):
        from decimal import ROUND_HALF_EVEN, Decimal

        for u, name in units:
            if n >= u:
                return f"{(Decimal(n) / u).quantize(Decimal('0.01'), ROUND_HALF_EVEN)} {name}"
        return f"{n} B"

    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", catalog.scalars.human(catalog.F.col("n")).alias("h")).collect()
    assert {r["n"]: r["h"] for r in got} == {n: plain(n) for n in sizes}


def test_stream_pack_takes_files_in_any_order(spark, tmp_path):
    """Files that arrive with the last documents first, or hold every ninth one, with empty and null texts among texts larger than a block."""
    import os

    from stratarc.operators.blocks import greedy

    lengths = [0, 70_000, 0, 0, 70_000, 0, 9, 65_527, 0, 66_000, 0] + [(i * 7919) % 30_000 for i in range(200)] + [0]
    for name, gap in (("strided", None), ("runs", None), ("nulls", 150)):
        docs = [(i, None if gap and i in (gap, gap + 9) else "x" * n) for i, n in enumerate(lengths)]
        folder = tmp_path / name / "documents.parquet"
        folder.mkdir(parents=True)
        for k in range(9):
            part = docs[k::9] if name == "strided" else docs[k * 24 : (k + 1) * 24]
            spark.createDataFrame(part, "doc_id long, text string").toPandas().to_parquet(folder / f"part-{k}.parquet")
            os.utime(folder / f"part-{k}.parquet", (2_000_000_000 - 100 * k,) * 2)
        want = greedy(lengths[: gap or len(lengths)], catalog.BLOCK)
        want += want[-1:] * (len(lengths) - len(want))
        got = {r["seq"]: (r["chunk_len"], r["block_id"]) for r in catalog.QUERIES["stream_pack"](spark, str(tmp_path / name)).collect()}
        assert got == {i: (None if t is None else len(t), b) for (i, t), b in zip(docs, want, strict=True)}


def test_context_roundtrip_on_near_copies(spark, tmp_path):
    """Blocks of documents most of which are near copies of one another."""
    import random

    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randrange(2, 10))) for _ in range(3000)]
    texts = []
    for i in range(96):
        words = [vocabulary[min(int(r.expovariate(0.005)), 2999)] for _ in range(300)] if i % 4 == 0 else list(r.choice(texts[-(i % 32) :]))
        words[r.randrange(300)] = f"word{i}"
        texts.append(words)
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, " ".join(t), "en", "src0") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(folder)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    assert rows(catalog.QUERIES["context_roundtrip"](spark, str(tmp_path)).toPandas()) == rows(c.execute(catalog.ORACLES["context_roundtrip"]).df())
