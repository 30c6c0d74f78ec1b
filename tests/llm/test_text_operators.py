"""Operators on texts against brute force, on small tables with every odd case."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratarc.llm import chat, exact_dedup, lm_scoring, minhash, mixing, packing, quality, range_coder, secrets_scan, token_binary
from stratarc.llm.common import scratch_path
from stratarc.llm.tokens import default_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, len string, shard int"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, long texts, columns with clashing names."""
    base = " ".join(f"word{i % 37}x{i % 11}" for i in range(300))
    rows = [
        (5, base, "en", "a"), (3, base.replace(" ", " \n\t"), "en", "a"), (9, base + " extra", "en", None), (4, None, None, "b"), (8, "", "fr", "b"), (2, " \n ", "fr", "c"), (7, "one two", "de", "c"),
        (6, "one\ttwo", "de", "c"), (7, "one two", "de", "c"), (None, "no id at all here", "en", "a"), (None, base, "en", "d"), (1, "Ünïcode \u00a0 text \x1c with 漢字 and <|endoftext|> it's 'S don't", "en", "b"), (12, "x" * 5000 + " " + "y, " * 4000, "en", "a"),
        (13, "one two three four five", "es", None), (14, "ONE two three four five", "es", "e"), (7, "another text under a used id", "de", "c"),
    ]
    return spark.createDataFrame([(d, t, la, s, len(t or ""), 1, "z", 0) for d, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.mark.parametrize("all_digests", [True, False])
def test_exact_groups(odd, docs, empty, all_digests):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rows]
        groups = {}
        for r, n in zip(rows, normal, strict=True):
            groups.setdefault(n, []).append(r["doc_id"])
        want = Counter()
        for ids in groups.values():
            keep = min((i for i in ids if i is not None), default=None)
            for i, n in Counter(ids).items():
                want[i, keep, len(ids), i == keep] += 1
                if n > 1:
                    want[i, keep, len(ids), False] += n - 1
        got = exact_dedup.exact_groups(df, digest_all=all_digests).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
        if all_digests:
            assert Counter(r["text_sha256"] for r in got) == Counter(hashlib.sha256(n.encode()).hexdigest() for n in normal)
    assert exact_dedup.exact_groups(empty, digest_all=all_digests).count() == 0


def test_drop_exact_leaves_one_of_each(odd, empty):
    left = exact_dedup.drop_exact(odd)
    assert left.columns == odd.columns
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in left.collect()]
    assert len(normal) == len(set(normal)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in odd.collect()})
    assert exact_dedup.drop_exact(empty).count() == 0
    clash = odd.withColumns({"xd_id": F.lit(1), "xd_null": F.lit("n"), "xd_sha": F.lit(None).cast("string"), "row": F.lit(2.5), "nd_id": F.lit(3), "kept": F.lit(False), "m": F.create_map(F.lit("k"), "lang")})
    there = exact_dedup.drop_exact(clash)
    assert there.columns == clash.columns and Counter(r["doc_id"] for r in there.collect()) == Counter(r["doc_id"] for r in left.collect())
    assert exact_dedup.drop_exact(clash.where("false")).count() == 0


def test_mixing(odd, docs, empty):
    for df in (docs, odd):
        got = mixing.mix_sources(df).collect()
        sizes = Counter()
        for r in df.collect():
            sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        target, left, total = {}, set(order), sum(sizes.values())
        while left:  # reshare until none is above its cap
            level = (total - sum(target.values())) / sum(weight[s] for s in left)
            full = {s for s in left if level * weight[s] > 3 * sizes[s]}
            if not full:
                target |= {s: level * weight[s] for s in left}
                break
            target |= {s: 3.0 * sizes[s] for s in full}
            left -= full
        taken, longest = Counter(), Counter()
        for r in got:
            assert r["mx_target"] == pytest.approx(target[r["source"]]) and r["mx_source_size"] == sizes[r["source"]]
            assert r["mx_taken"] <= 3 * r["mx_size"]
            taken[r["source"]] += r["mx_taken"]
            longest[r["source"]] = max(longest[r["source"]], r["mx_size"])
        assert len(got) == df.count()
        for s in order:
            assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6
    again = mixing.mix_sources(docs).select("doc_id", "mx_taken")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.mix_sources(docs).select("doc_id", "mx_taken").collect()))
    assert mixing.mix_sources(empty).count() == 0


def test_sources_without_words(spark):
    some = [(1, "a b c d", "x", 1.5), (2, "", "y", 2.5), (3, None, "y", None), (4, "e f", None, 0.0)]
    for rows in (some, [(i, None, "y", None) for i in range(3)], [(9, " \n", None, 1.0)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, position double").withColumn("mx_size", F.lit("own")).withColumn("m", F.create_map(F.lit("a"), "doc_id"))
        mixed = mixing.mix_sources(df)
        assert mixed.columns[:6] == ["doc_id", "text", "source", "position", "mx_size_", "m"]
        got = {r["doc_id"]: r for r in mixed.collect()}
        assert len(got) == len(rows) and all(r["mx_size_"] == "own" for r in got.values())
        assert all(got[d]["mx_target"] == got[d]["mx_taken"] == 0 for d, _, s, _ in rows if s == "y")
        order = mixing.training_order(df)
        assert order.columns == [*df.columns, "position_"]
        assert {r["doc_id"] for r in order.collect()} == ({1} if rows is some else set())


def test_training_order_follows_the_schedules(spark):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.lit("a b c d").alias("text"))
    rows = mixing.training_order(df).collect()
    at = [r["position"] for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    first = Counter(r["source"] for r in rows if r["position"] < 0.5)
    every = Counter(r["source"] for r in rows)
    # integrals of the schedules' first halves: 2.75 of 5, 1 of 2, 0.375 of 1
    for s, share in (("s0", 0.55), ("s1", 0.5), ("s2", 0.375)):
        assert first[s] / every[s] == pytest.approx(share, abs=0.02)
    assert mixing._invert(F.lit(0.375), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))) is not None


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "</turn>", "a\n</turn>\nb", "\\</turn>", "### Assistant: x", "ends with \\", "ends </turn>", "\\\\### \\\\\\</turn>\n", "# ## #### <turn>", "ü漢😀", "### user: a\n</turn>\n### assistant: b\n</turn>\n"]
    roles = ["user", "assistant", "a: b", "x%3Ay", "</turn>\n", None, "assistant"]
    rows = [(c, t, roles[(c + t) % len(roles)], texts[(c * 5 + t) % len(texts)], "x") for c in range(12) for t in range(9)] + [(None, 1, "user", "null id", "x"), (3, 4, "assistant", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    shaped = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(shaped).collect()}
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        under = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(under) and got[c]["loss_sha256"] == hashlib.sha256(under.encode()).hexdigest()
    assert {r["conv_id"]: len(r["formatted"]) for r in shaped.collect()} == {c: r["formatted_chars"] for c, r in got.items()}
    assert chat.format_conversations(df.where("false")).count() == 0


def test_long_runs_of_escapes(spark):
    text = "\\" * 300_000 + "x" + "\\" * 200_000 + "</turn>\n" + "#" * 100_001
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    began = time.time()
    row = chat.read_back(chat.format_conversations(df)).first()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["n_turns"] == 1
    assert time.time() - began < 60


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_range_coder():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 4095, 4096, 4097, 30_000):
        ids = (rng.zipf(1.3, n) % 49_408).astype(np.uint16)
        frame = range_coder.encode(ids)
        assert (range_coder.decode(frame) == ids).all()
    assert len(range_coder.encode(np.tile(ids[:300], 40))) < 4000  # repeats are predicted
    for at in (30, len(frame) // 2, len(frame) - 200):
        with pytest.raises(Exception):  # noqa: B017 - a checksum, or zlib's own error
            range_coder.decode(frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :])
    with pytest.raises(ValueError):
        range_coder.decode(frame[:-2])


def test_token_files(spark, odd, docs, empty, tokenizer):
    for df in (docs, odd):
        path = scratch_path(spark, "test")
        token_binary.write_ids(df, path)
        got = token_binary.read_ids(spark, path).orderBy("start").collect()
        at, seen = 0, Counter()
        for r in got:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["n_tokens"]
            seen[r["doc_id"], tuple(r["ids"])] += 1
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
        assert seen == Counter((r["doc_id"], (*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2)) for r in df.collect())
    path = scratch_path(spark, "test")
    token_binary.write_ids(empty, path)
    assert token_binary.read_ids(spark, path).count() == 0


def test_packing(odd, docs, empty, tokenizer):
    for df, most in ((docs, 2048), (odd, 64)):
        got = packing.pack(df, most=most).toPandas()
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= most
        want = Counter()
        for r in df.collect():
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            for i in range(0, len(ids), most):
                part = ids[i : i + most]
                want[r["doc_id"], i // most, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        rows = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got[["doc_id", "piece", "start", "length", "ids_crc32"]].notna(), None)
        assert Counter(rows.itertuples(index=False, name=None)) == want
        assert got.sequence_id.nunique() <= got.length.sum() / most * 1.05 + 2
    assert packing.pack(empty).count() == 0


def test_packing_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6, 1.1, 20_000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=2049)
    plan, used = packing.plan_sequences(counts, 2048), np.zeros(2049, int)
    for pattern, times in plan:
        assert sum(pattern) <= 2048 and times > 0
        for n in pattern:
            used[n] += times
    assert (used == counts).all() and sum(t for _, t in plan) <= lengths.sum() / 2048 * 1.005 + 1


def test_language_model(odd, docs, empty):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        texts = [(r["doc_id"], [*WORDS.findall(low(r["text"])), "\0end"]) for r in rows]
        train = [x for d, x in texts if not lm_scoring.held_out(d)]
        c = Counter(w for x in train for w in x)
        big = Counter(p for x in train for p in zip([None, *x], x, strict=False))
        cont, n, v = Counter(b for _, b in big), sum(c.values()), len(c)
        of = lambda values: lm_scoring.discounts(np.array([sum(z == k for z in values) for k in (1, 2, 3, 4)]))
        high, flat = of(list(big.values())), of(list(cont.values()))
        total, gamma = Counter(), Counter()
        for (a, _), k in big.items():
            total[a] += k
            gamma[a] += high[min(k, 3)]
        spare = sum(flat[min(k, 3)] for k in cont.values())
        lower = lambda w: (max(cont[w] - flat[min(cont[w], 3)], 0) + spare / (v + 1)) / len(big)  # noqa: B023, E731
        p = lambda a, w: (max(big[a, w] - high[min(big[a, w], 3)], 0) + gamma[a] * lower(w)) / total[a] if total[a] else lower(w)  # noqa: B023, E731
        want = Counter()
        for d, x in texts:
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
            want[d, lm_scoring.held_out(d), len(x), sum(c[w] > 0 for w in x), n, round(base, 6), round(sum(math.log10(p(a, w)) for a, w in zip([None, *x], x, strict=False)), 6)] += 1
        got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_scoring.score_texts(df).collect())
        assert got == want
        word = next(iter(c))
        assert sum(p(word, w) for w in c) + p(word, "\0unknown") == pytest.approx(1)
    assert lm_scoring.score_texts(empty).count() == 0


def brute_components(rows, percent):
    """Component of each doc_id by full comparison; rows that share an id are one node."""
    sets = []
    for d, t in rows:
        w = WORDS.findall(low(t))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, odd, docs, empty, percent):
    rng = np.random.default_rng(percent)
    text = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    chain = []
    for i in range(60):  # a drifting text: neighbours are similar, far ones are not; blocks hold several components
        chain.append((1000 + i, " ".join(text), "en", "s", 0, 0, "", 0))
        text = [*text]
        for j in rng.integers(0, 120, 1 + i % 3):
            text[j] = f"n{rng.integers(0, 10**9)}"
    for df in (docs, odd, spark.createDataFrame(chain, SCHEMA)):
        want = brute_components([(r["doc_id"], r["text"]) for r in df.collect()], percent)
        got = minhash.near_duplicates(df, percent).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(empty, percent).count() == 0
    assert minhash.drop_near(odd, percent).columns == odd.columns


def test_quality(spark, docs, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, aside = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    scored = quality.score(big, fit).join(aside, "doc_id").collect()
    good, bad = [r for r in scored if r["quality"] == 1], [r for r in scored if r["quality"] == 0]
    assert sum(r["accepted"] for r in good) >= 0.98 * len(good)
    assert sum(r["accepted"] for r in bad) <= 0.15 * len(bad)
    got = quality.score(odd, spark.createDataFrame([(5, 1), (8, 0), (7, None), (None, 1), (5, 0)], "doc_id long, quality int"))
    assert got.count() == odd.count() and got.where("score IS NULL OR isnan(score)").isEmpty()
    assert quality.score(odd, labels.where("false")).where("NOT accepted").isEmpty()
    assert quality.score(empty, labels).count() == 0
    kept = quality.keep_good(big, labels)
    assert kept.columns == big.columns and 0.7 * big.count() < kept.count() < big.count()


def test_secrets(spark, docs, odd, empty):
    forest = secrets_scan.train()
    made = secrets_scan.labelled_findings(800, seed=77)
    x = np.array([secrets_scan.features(secrets_scan.kind_of(v, b), v, b, a) for v, b, a, _ in made], float)
    assert ((forest.predict(x) >= 0.5) == np.array([y for *_, y in made])).mean() > 0.95
    key = "AKIA" + "Q7ZK2MXP4RTW8LVB"
    rows = [
        (1, f'before token = "{"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"}" after', 1), (2, f"😀 id {key} here", 1), (3, 'password = "changeme" ok', 0), (4, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b done", 0),
        (5, None, 0), (6, "", 0), (None, f"x {key} y", 1), (7, "x" * 100_000 + f" secret: {'Zx9' * 9}k2", 1), (8, "no secrets in plain words, none at all", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = secrets_scan.scan(df).collect()
    assert {r["doc_id"] for r in got if r["is_secret"]} == {d for d, _, y in rows if y}
    hit = next(r for r in got if r["doc_id"] == 2)
    assert rows[1][1][hit["start"] : hit["start"] + hit["length"]] == key and hit["secret_sha256"] == hashlib.sha256(key.encode()).hexdigest()
    assert secrets_scan.scan(empty).count() == 0
    findings = spark.createDataFrame(made[:400], "value string, before string, after string, label int")
    assert secrets_scan.scan(df, findings).where("is_secret").count() >= 3


def test_findings_of_foreign_shape(spark, docs):
    """Kinds of secrets and of look-alikes that the generator does not make, in lines of configuration, code and prose."""
    rng = np.random.default_rng(21)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    alnum, hexes = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    words = [w for w in (docs.first()["text"] or "").split() if w.isalpha() and len(w) > 4][:60]
    some = lambda n, sep: sep.join(rng.choice(words, n))
    good = [
        lambda: (f"npm_{pick(alnum, 36)}", "//registry/:_authToken=", ""), lambda: (f"SG.{pick(alnum, 22)}.{pick(alnum, 43)}", "mail.api_key: ", ""), lambda: (f"glpat-{pick(alnum, 20)}", "export CI_TOKEN=", ""),
        lambda: (f"{pick(alnum, 16)}", "db.password=", ""), lambda: (pick(hexes, 40), 'client_secret: "', '"'), lambda: (f"{pick(alnum, 9)}!{pick(alnum, 3)}", "smtp_passwd = ", ""),
        lambda: (f"AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}", "key id ", ""), lambda: (f"ghp_{pick(alnum, 36)}", "remote uses ", ""),
    ]
    bad = [
        lambda: (f"{pick(hexes, 64)}", "sha256 digest ", " of the file"), lambda: (some(4, "-") + f"-{rng.integers(1000)}", "see https://www.site.org/blog/", ""), lambda: (f"{pick(hexes, 40)}", "commit ", ""),
        lambda: (some(2, "") + ".", "the token: ", ""), lambda: ("${VAULT_PASSWORD}", "password=", ""), lambda: (some(5, "_") + "_2", "def ", "(): pass"), lambda: ("your_token_here", "api_key=", ""), lambda: (some(6, "/") + "/v2", "GET /", " HTTP"),
    ]
    made = [(*m(), y) for y, makers in ((1, good), (0, bad)) for m in makers for _ in range(12)]
    lines = [f"{some(5, ' ')}\n{b}{v}{a}\n{some(4, ' ')}" for v, b, a, _ in made]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    named = {r["doc_id"] for r in secrets_scan.scan(df).where("is_secret AND doc_id < 100000").collect()}
    caught = np.mean([i in named for i, m in enumerate(made) if m[3]])
    wrong = np.mean([i in named for i, m in enumerate(made) if not m[3]])
    assert caught >= 0.9 and wrong <= 0.15, (caught, wrong, Counter(i // 12 for i in named))


def test_dictionary_is_counted_over_all_rows(spark, odd, docs, empty):
    for df in (odd, docs):
        want = Counter(w for r in df.select("text").collect() for w in WORDS.findall(low(r["text"])) if re.fullmatch("[a-z]{4,14}", w))
        top = {w for w, _ in sorted(want.items(), key=lambda x: (-x[1], x[0]))[:150]}
        assert secrets_scan.language(df, 150).words == top | {w for w in secrets_scan.PLACEHOLDERS if len(w) > 3}
    assert secrets_scan.language(empty).covered("xkq") == 0


def test_secrets_of_longer_identifiers(spark):
    lines = [
        ("DB_PASSWORD=", "hunter2x!Q9"), ("SECRET_KEY = '", "dj4ng0k3y!z"), ("access_token: ", "8fk29fj2kd93"), ("auth_token=", "abc123def456"), ("aws_secret_access_key = ", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYq2Zt8LmV3s"),
        ("my.dbPassword-2: ", "hunter2x!Q9"), ("free ", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYq2Zt8LmV3s"), ("bare token=", "8fk29fj2kd93"),
    ]
    rows = [(i, f"{before}{value}' end") for i, (before, value) in enumerate(lines)]
    got = {(r["doc_id"], r["start"], r["secret_sha256"]) for r in secrets_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, len(b), hashlib.sha256(v.encode()).hexdigest()) for i, (b, v) in enumerate(lines)} <= got
    part = "4f3c2b1a" * 5
    assert {(a, b) for _, a, b in secrets_scan.find(f"see v1/{part}/send")} == {(4, 52), (7, 47)}  # the part of a path stays a candidate
    assert secrets_scan.find("token" * 40_000 + "\n" + "=" * 200_000) == []


def test_long_secrets_are_whole(spark):
    rng = np.random.default_rng(8)
    long = "".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789"), 450))
    late = "k" * 50 + "0123456789"
    rows = [(1, f"token={long} end", long), (2, f"my_secret: '{long}'", long), (3, f"see {late} end", late), (4, f"see {long} end", long)]
    got = secrets_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["secret_sha256"]) for r in got) == [(d, t.index(v), len(v), hashlib.sha256(v.encode()).hexdigest()) for d, t, v in rows]


def test_overlaps_are_found_by_order():
    text = " ".join(f"token_{i}=ab{i}cd{'/' * (i % 3)}{'e7' * (i % 17)}" for i in range(20_000))
    began = time.time()
    found = secrets_scan.find(text)
    assert time.time() - began < 20 and sum(k == "assigned" for k, _, _ in found) == 20_000
    small = text[:4000]
    taken = []
    for kind, pattern in secrets_scan.COMPILED:
        for m in pattern.finditer(small):
            a, b = m.span(1)
            if not any(a < y and x < b and not (k == kind == "mixed") for x, y, k in taken):
                taken.append((a, b, kind))
    assert secrets_scan.find(small) == [(k, a, b) for a, b, k in sorted(taken)]


def test_words_whose_letters_change(spark, tokenizer):
    import pyarrow as pa

    from stratarc.llm.tokens import WordEncoder

    letters = ["\u0130", "\u0958", "\u095f", "\u09dc", "\ufb1d", "\ufb4e", "\u00e9", "\u03a3", "\u00df", "\u01c5"]
    words = ["İKİ,", "ESKİ.", "aİ!", "ve İ", *(f"{before}{c}{after}" for c in letters for before in ("", "ab") for after in ("", ",", "...", "d!"))]
    ids, ends = WordEncoder(default_path()).of_texts(pa.array(words))
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    path = scratch_path(spark, "test")
    token_binary.write_ids(df, path)
    assert {r["doc_id"]: r["ids"] for r in token_binary.read_ids(spark, path).collect()} == {i: [*tokenizer.encode(w, add_special_tokens=False).ids, 2] for i, w in enumerate(words)}


def test_quality_fit_sees_each_document_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    hot = docs.join(labels, "doc_id", "left_semi").orderBy("doc_id").limit(1).crossJoin(spark.range(2000)).drop("id")
    other = docs.limit(20).withColumn("text", F.concat("text", F.lit(" and more")))
    weights = lambda df: quality.train(df, labels, fit_rows=100_000, pool_rows=50).combined.w
    assert (weights(hot.unionByName(docs)) == weights(docs)).all()
    assert (weights(docs.unionByName(other)) == weights(other.unionByName(docs).repartition(7))).all()
