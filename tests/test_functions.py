import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratarc.functions import codecs, context_codec, copies, transforms
from stratarc.operators.blocks import greedy
from stratarc.operators.chunking import cuts

SETS = [set(transforms.OPCODES_1), set(transforms.OPCODES_2)]
ODD = [0xE8, 0xE9, 0x48, 0x8B, 5, 0x0F, 0x66, 0x10, 0x0D, 0x94, 0x40, 0x25, 1, 0xFF, 0]


def biased(seed: int, n: int) -> bytes:
    r = random.Random(seed)
    return bytes(r.choice(ODD) if r.random() < 0.8 else r.randrange(256) for _ in range(n))


@pytest.mark.parametrize("transform", [0, 1, 2, 3, 4])
def test_transforms_come_back(transform):
    for seed in range(400):
        data = biased(seed, seed % 61)
        done = transforms.apply(transform, data)
        assert len(done) == len(data)
        assert transforms.apply(transform, done, False) == data
    big = biased(7, 100_003)
    assert transforms.apply(transform, transforms.apply(transform, big), False) == big


def _field(b, i, end):
    if b[i] == 0xE8:
        return i + 1
    j = i + (b[i] in (0x66, 0xF2, 0xF3))
    j += j < end and b[j] & 0xF0 == 0x40
    if j + 7 <= end and b[j] == 0x0F and b[j + 1] in SETS[1] and b[j + 2] & 0xC7 == 5:
        return j + 3
    if j + 6 <= end and b[j] in SETS[0] and b[j + 1] & 0xC7 == 5:
        return j + 2
    return None


def test_split_moves_the_fields_that_the_format_names():
    for seed in range(300):
        data = biased(seed, seed % 53)
        n, i, code, tail = len(data), 0, b"", b""
        while i + 5 <= n:
            f = _field(data, i, n)
            if f is None:
                code, i = code + data[i : i + 1], i + 1
            else:
                moved = transforms._moved(int.from_bytes(data[f : f + 4], "little"), i, transforms.range_bits(n))
                code, tail, i = code + data[i:f], moved.to_bytes(4, "big") + tail, f + 4
        assert transforms.split_encode(data) == code + data[i:] + tail


@pytest.mark.parametrize(("n", "bits"), [(0, 23), (1 << 23, 23), ((1 << 23) + 1, 24), (48_051_472, 26), ((1 << 40), 31)])
def test_range_bits(n, bits):
    assert transforms.range_bits(n) == bits


def prose(seed: int, words: int) -> bytes:
    r = random.Random(seed)
    known = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(120)]
    return " ".join(known[min(int(r.expovariate(0.05)), 119)] for _ in range(words)).encode()


@pytest.mark.parametrize("plan", [(1,), (1, 2), (2,), (5, 1), (3,), (4,), ()])
def test_codecs_come_back(plan):
    data = prose(1, 400)
    for d in (data, b"\0", random.Random(2).randbytes(700)):
        codec, payload = codecs.compress(d, plan, 19, data[:500])
        assert len(payload) <= len(d)
        assert codecs.decompress(codec, payload, len(d), data[:500]) == d


def test_damage_is_refused():
    data = b"abc" * 500
    codec, payload = codecs.compress(data, (codecs.ZSTD,), 3)
    for bad in (payload[:-1], payload + b"x"):
        with pytest.raises(Exception):  # noqa: B017 - each library has its own
            codecs.decompress(codec, bad, len(data))
    with pytest.raises(ValueError):
        codecs.decompress(codec, payload, len(data) + 1)
    with pytest.raises(ValueError):
        codecs.decompress(9, payload, len(data))


@pytest.mark.parametrize("fast", [False, True])
def test_context_codec(fast):
    data = prose(3, 900)
    for n in (0, 1, 3, 511, 513, 1025, 2600, len(data)):
        payload = context_codec.compress(data[:n], fast)
        assert context_codec.decompress(payload, n, fast) == data[:n]
    import zstandard

    assert len(payload) < len(zstandard.ZstdCompressor(level=19).compress(data))
    for bad in (payload[:-2], payload + b"ab", b"\2" + payload[1:], payload[:9]):
        with pytest.raises(ValueError):
            context_codec.decompress(bad, len(data), fast)
    noise = random.Random(5).randbytes(3000)
    assert context_codec.decompress(context_codec.compress(noise, fast), 3000, fast) == noise
    assert context_codec.decompress(context_codec.compress(bytes(5000), fast), 5000, fast) == bytes(5000)
    primed = context_codec.compress(data[:120], fast, data[:400])
    assert primed[0] == 1 and context_codec.decompress(primed, 120, fast, data[:400]) == data[:120]
    with pytest.raises(ValueError):
        context_codec.decompress(primed, 120, fast)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(17, 200), st.integers(1, 12))
def test_cuts_tile_the_content(data, least, bits):
    ends = cuts(data, least, bits, least * 4)
    assert (ends[-1] if ends else 0) == len(data)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert all(least <= n <= 4 * least for n in sizes[:-1]) and all(0 < n <= 4 * least for n in sizes)


def test_an_insertion_moves_few_cuts():
    r = random.Random(5)
    data = bytes(r.randrange(256) for _ in range(200_000))

    def parts(d):
        ends = cuts(d, 256, 9, 4096)
        return {d[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    a, b = parts(data), parts(data[:1000] + b"inserted" + data[1000:])
    assert len(a - b) <= 3


def test_greedy():
    assert greedy([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3]


def test_priming_data_is_used():
    rng = random.Random(4)
    dictionary = bytes(rng.randrange(256) for _ in range(600))
    data = dictionary[100:500]
    for level, used in ((1, codecs.ZSTD_PRIMED), (7, codecs.ZSTD_PRIMED), (9, codecs.ZSTD_PRIMED), (10, codecs.CONTEXT_FAST), (11, codecs.CONTEXT)):
        plan, zstd_level, _ = codecs.LEVELS[level]
        codec, payload = codecs.compress(data, plan, zstd_level, dictionary)
        assert codec == used and len(payload) < 200
        assert codecs.decompress(codec, payload, len(data), dictionary) == data
    for other in (None, b""):
        assert codecs.compress(data, *codecs.LEVELS[7][:2], other) == (codecs.STORE, data)
    big = dictionary * 2000
    assert codecs.compress(big, *codecs.LEVELS[1][:2], dictionary)[0] == codecs.ZSTD


def test_varint_lengths_beyond_seven_bytes(spark):
    from pyspark.sql import functions as F

    from stratarc.functions import scalars

    edges = [n for k in range(1, 10) for n in ((1 << 7 * k) - 1, 1 << 7 * k) if n < 1 << 63]
    got = spark.createDataFrame([(n,) for n in edges], "n long").select("n", scalars.varint_length(F.col("n")).alias("bytes")).collect()
    assert {r["n"]: r["bytes"] for r in got} == {n: -(-n.bit_length() // 7) for n in edges}


def test_context_codec_runs_blocks_together():
    """Two dozen blocks together cost less than five one after the other, each gives the payload that it gives alone, and a damaged one spoils no other."""
    import time

    blocks = [prose(i, 40 + 60 * (i % 5)) for i in range(24)] + [b"", b"x"]
    for fast in (False, True):
        start = time.process_time()
        payloads = context_codec.compress_all(blocks, fast)
        together = time.process_time() - start
        start = time.process_time()
        assert [context_codec.compress(d, fast) for d in blocks[:5]] == payloads[:5]
        assert together < time.process_time() - start
        hurt = [p[:-2] if i == 3 else p for i, p in enumerate(payloads)]
        assert context_codec.decompress_all(hurt, list(map(len, blocks)), fast) == [None if i == 3 else d for i, d in enumerate(blocks)]


def near_copies(seed: int) -> bytes:
    """Texts of which each other one is an earlier one with a word changed."""
    r, texts, new = random.Random(seed), [], iter(prose(seed, 15 * 150).split(b" "))
    for i in range(30):
        words = [next(new) for _ in range(150)] if i % 2 == 0 else r.choice(texts).split(b" ")
        words[r.randrange(len(words))] = b"changed%d" % i
        texts.append(b" ".join(words))
    return b"\n".join(texts)


@pytest.mark.parametrize("fast", [False, True])
def test_context_codec_takes_copies_out(fast):
    """Blocks of near copies take less than with zstd; damaged lists are found, and spoil no other block; short repeats of templates aren't taken out at a loss."""
    blocks = [near_copies(i) for i in range(4)]
    payloads = context_codec.compress_all(blocks, fast)
    for data, payload in zip(blocks, payloads, strict=True):
        assert payload[0] == context_codec.COPIES and len(payload) < len(codecs.compress(data, (codecs.ZSTD,), 19)[1])
        assert payload == context_codec.compress(data, fast)
    one = payloads[1]
    for bad in (one[:3], one[:9], one[:1] + b"\xff\xff\xff\xff" + one[5:], one[:5] + b"\0" + one[6:], one[:5] + b"\xff" * 6 + one[11:], one[:-2]):
        with pytest.raises(ValueError):
            context_codec.decompress(bad, len(blocks[1]), fast)
        assert context_codec.decompress_all([payloads[0], bad, *payloads[2:]], list(map(len, blocks)), fast) == [blocks[0], None, *blocks[2:]]
    r = random.Random(9)
    log = b"".join(b"2026-01-01 00:00:%02d GET /index/%d.html HTTP/1.1 status=200 bytes=%d\n" % (r.randrange(60), r.randrange(1000), r.randrange(99_999)) for _ in range(800))
    assert context_codec.compress(log, fast) == context_codec._coded([log], not fast, b"")[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=90), st.integers(0, 3000), st.integers(0, 700)), max_size=12), st.sampled_from([40, 1000, copies.SEARCHED]))
def test_copies_are_put_back(parts, searched):
    data = b""
    for new, at, n in parts:
        data += new
        data += data[at : at + n]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(copies, "SEARCHED", searched)
        for literals, listed in copies.ways(data):
            assert copies.put_back(literals, copies.read(listed, len(data))) == data
