"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

1. Blocks: texts become rows of a few million tokens with a block-local dictionary of 64-bit word hashes; everything else
   reads these, so texts are split once.
2. Words: each block's training counts go to shards by hash range, which merge them into sorted arrays of hashes and counts,
   written as files. A word's number is its place in them. Workers memory-map these files; nothing of the vocabulary goes
   through the driver.
3. Bigrams: a task merges the distinct pairs of its blocks (two word numbers in 64 bits, with their training count) and sends them to the
   shards that the pairs' hashes name. A shard merges them, writes its sorted arrays of pairs and counts, and adds up what its
   pairs say of contexts and continuations. A frequent word or pair arrives once per task, so no shard is hot.
4. Context and continuation sums per word become memory-mapped arrays by ranges of word numbers; count-of-counts give the discounts.
5. Scoring reads the blocks once more, without a shuffle: workers map the arrays, look up a block's distinct words, pairs and contexts by
   binary search, and sum log probabilities per text.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token. A text's first token has a start context.
Training texts are those whose crc32 of doc_id as text is not 0 modulo ``folds``. An unknown word gets the share of one
more word in the uniform base distribution; an unseen context backs off to continuation probabilities.

Nulls: a null text is empty (its end token alone); a null doc_id counts as the text '' and so is held out. Repeated rows count and are
scored each. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import discard, frugal, hash_words, mix64, scratch_path, split_words, squeeze, unsqueeze, written
from stratarc.llm.shared_files import mapped, put
from stratarc.llm.tokens import text_slices

END = np.uint64(0x656E646F66746578)
RANGE = 1 << 18
#: Pairs that a task merges before it sends them on, and training tokens per shard of pairs.
MERGED, SHARD_TOKENS = 3_000_000, 2_000_000
BLOCK_SQL = "block long, docs long, doc_ids binary, no_id binary, held binary, ends binary, words binary, codes binary"
STAT = np.dtype([("total", "<i8"), ("n1", "<i8"), ("n2", "<i8"), ("n3", "<i8"), ("cont", "<i8")])


def held_out(doc_id: int | None, folds: int = 10) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def token_blocks(docs: DataFrame, folds: int) -> DataFrame:
    """Rows of many documents each: ids, hold-out flags, token ends, distinct word hashes and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in text_slices(whole, "text"):
                unique, codes, ends = split_words(batch.column("text"), lower=True)
                words, place = np.unique(np.concatenate([hash_words(unique), [END]]).astype("<u8"), return_inverse=True)
                codes = place[np.insert(codes, ends, len(unique))].astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                ids = batch.column("doc_id").to_pylist()
                flags = np.array([held_out(d, folds) for d in ids], np.uint8)
                plain = [np.array([d or 0 for d in ids], "<i8"), np.array([d is None for d in ids], np.uint8), flags, ends.astype("<i8")]
                data = [*(x.tobytes() for x in plain), squeeze(words, True), squeeze(codes)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(ids)]), *(pa.array([x], pa.binary()) for x in data)], names=["block", "docs", "doc_ids", "no_id", "held", "ends", "words", "codes"])
                block += 1

    return docs.mapInArrow(run, BLOCK_SQL)


class _Block:
    def __init__(self, row: dict) -> None:
        read = lambda k, t: np.frombuffer(row[k], t)
        self.block, self.ends = row["block"], read("ends", "<i8")
        self.ids = [None if z else int(d) for d, z in zip(read("doc_ids", "<i8"), read("no_id", np.uint8), strict=True)]
        self.held, self.codes = read("held", np.uint8), unsqueeze(row["codes"], "<u4")
        self.words = unsqueeze(row["words"], "<u8", True)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.train = np.repeat(self.held == 0, self.ends - self.begins)

    def pairs(self, numbers: np.ndarray, start: int) -> np.ndarray:
        """For each token, its context's and its own number in one 64-bit key."""
        own = numbers[self.codes].astype(np.uint64)
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.begins] = start
        return (before << np.uint64(32)) | own


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    frugal()
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the values that belong to each."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], *(np.add.reduceat(v[order], at) for v in values)


def _pack(shards: np.ndarray, count: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays split by shard number, their order kept."""
    by = np.argsort(shards, kind="stable")
    cuts = np.searchsorted(shards[by], np.arange(count + 1))
    for s in range(count):
        if cuts[s] < cuts[s + 1]:
            yield s, [a[by[cuts[s] : cuts[s + 1]]] for a in arrays]


def count_words(blocks: DataFrame, root: str, shards: int) -> list[int]:
    """Write the word files; how many words each shard has."""
    width = np.uint64(64 - (shards - 1).bit_length()) if shards > 1 else None

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _Block(row)
            n = np.bincount(b.codes[b.train], minlength=len(b.words))
            there = n > 0
            words, n = b.words[there], n[there].astype("<i8")
            shard = (words >> width).astype(np.int64) if width is not None else np.zeros(len(words), np.int64)
            rows = [(s, (squeeze(k, True), squeeze(v))) for s, (k, v) in _pack(shard, shards, words, n)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x[0] for _, x in rows], pa.binary()), pa.array([x[1] for _, x in rows], pa.binary())], names=["shard", "keys", "n"])

    def merge(table: pa.Table) -> pa.Table:
        frugal()
        keys, n = _summed(*(np.concatenate(x) for x in ([unsqueeze(b, "<u8", True) for b in table.column("keys").to_pylist()], [unsqueeze(b, "<i8") for b in table.column("n").to_pylist()])))
        shard = table.column("shard")[0].as_py()
        put(f"{root}/words-{shard}", keys.astype("<u8").tobytes())
        put(f"{root}/counts-{shard}", n.astype("<i8").tobytes())
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(keys)]), "tokens": pa.array([int(n.sum())])})

    parts = blocks.select("block", "docs", "doc_ids", "no_id", "held", "ends", "words", "codes").mapInArrow(local, "shard int, keys binary, n binary")
    sizes = written(parts.groupBy("shard").applyInArrow(merge, "shard int, words long, tokens long"), "lm-words")
    found = {r["shard"]: (r["words"], r["tokens"]) for r in sizes.collect()}  # one row per shard
    return [found.get(s, (0, 0)) for s in range(shards)]


class _Words:
    """Numbers and counts of words from the mapped files."""

    def __init__(self, root: str, sizes: list) -> None:
        self.root, self.sizes = root, sizes
        self.base = np.cumsum([0] + [n for n, _ in sizes])

    def look(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (that of the unknown word: how many words there are) and training count of each."""
        shards = len(self.sizes)
        width = np.uint64(64 - (shards - 1).bit_length()) if shards > 1 else None
        shard = (words >> width).astype(np.int64) if width is not None else np.zeros(len(words), np.int64)
        number, count = np.full(len(words), self.base[-1], np.int64), np.zeros(len(words), np.int64)
        by = np.argsort(words, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        for s in range(shards):
            mine = by[cuts[s] : cuts[s + 1]]
            if len(mine) and self.sizes[s][0]:
                keys = mapped(f"{self.root}/words-{s}", "<u8")
                at = np.minimum(np.searchsorted(keys, words[mine]), len(keys) - 1)
                hit = keys[at] == words[mine]
                number[mine[hit]] = self.base[s] + at[hit]
                count[mine[hit]] = mapped(f"{self.root}/counts-{s}", "<i8")[at[hit]]
        return number, count


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix64(keys) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _put_counts(uri: str, n: np.ndarray) -> None:
    """Counts in a byte each; those of 255 or more are listed beside, by place."""
    many = np.flatnonzero(n >= 255)
    put(uri, np.minimum(n, 255).astype(np.uint8).tobytes())
    put(f"{uri}-more", np.stack([many, n[many]], 1).astype("<i8").tobytes())


def _get_counts(uri: str, at: np.ndarray) -> np.ndarray:
    n = mapped(uri, np.uint8)[at].astype(np.int64)
    if (high := np.flatnonzero(n == 255)).size:
        more = mapped(f"{uri}-more", "<i8").reshape(-1, 2)
        n[high] = more[np.searchsorted(more[:, 0], at[high]), 1]
    return n


def count_pairs(blocks: DataFrame, root: str, words: _Words, shards: int) -> DataFrame:
    """Write the pair files; rows of sums by range of word numbers, and one of count-of-counts (at -1) per shard."""
    vocabulary = int(words.base[-1])
    ranges = (vocabulary + 2) // RANGE + 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            rows = [(s, (squeeze(k, True), squeeze(v))) for s, (k, v) in _pack(_pair_shard(held[0], shards), shards, held[0], held[1].astype("<u4"))]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([x[0] for _, x in rows], pa.binary()), pa.array([x[1] for _, x in rows], pa.binary())], names=["shard", "keys", "n"])

        for row in _rows(batches):
            b = _Block(row)
            number, _ = words.look(b.words)
            keys = b.pairs(number, vocabulary + 1)[b.train]
            keys, n = np.unique(keys, return_counts=True)
            held = _summed(np.concatenate([held[0], keys]), np.concatenate([held[1], n]))
            if len(held[0]) >= MERGED:
                yield out()
                held = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(held[0]):
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        frugal()
        shard = table.column("shard")[0].as_py()
        keys, n = np.concatenate([unsqueeze(x.as_py(), "<u8", True) for x in table.column("keys")]), np.concatenate([unsqueeze(x.as_py(), "<u4") for x in table.column("n")])
        keys, n = _summed(keys, n.astype(np.int64))
        put(f"{root}/pairs-{shard}", keys.astype("<u8").tobytes())
        _put_counts(f"{root}/pair-counts-{shard}", n)
        out = [(-1, squeeze(np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], "<i8")))]
        left, right = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del keys
        # contexts come in order; continuations are counted by word
        first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        right, cont = np.unique(right, return_counts=True)
        ids = np.union1d(left[first], right)
        stat = np.zeros((6, len(ids)), "<i8")
        stat[0] = ids
        for k, v in enumerate((n, n == 1, n == 2, n >= 3), 1):
            stat[k, np.searchsorted(ids, left[first])] = np.add.reduceat(v.astype(np.int64), first)
        stat[5, np.searchsorted(ids, right)] = cont
        cuts = np.searchsorted(ids, np.arange(ranges + 1) * RANGE)
        out += [(r, squeeze(stat[:, cuts[r] : cuts[r + 1]].reshape(-1), True)) for r in range(ranges) if cuts[r] < cuts[r + 1]]
        return pa.table({"at": pa.array([a for a, _ in out], pa.int64()), "data": pa.array([d for _, d in out], pa.binary())})

    pairs = blocks.mapInArrow(local, "shard int, keys binary, n binary")
    return pairs.groupBy("shard").applyInArrow(merge, "at long, data binary")


def word_stats(counted: DataFrame, root: str) -> tuple[np.ndarray, np.ndarray]:
    """Write per-word sums of contexts and continuations; count-of-counts of pairs (and how many there are) and of continuations."""

    def merge(table: pa.Table) -> pa.Table:
        frugal()
        at = table.column("at")[0].as_py()
        found = np.zeros(9, np.int64)
        if at < 0:
            for x in table.column("data"):
                found[:5] += unsqueeze(x.as_py(), "<i8")
        else:
            out = np.zeros(RANGE, STAT)
            for x in table.column("data"):
                rows = unsqueeze(x.as_py(), "<i8", True).reshape(6, -1)
                for k, name in enumerate(STAT.names):
                    out[name][rows[0] - at * RANGE] += rows[k + 1]  # a shard lists a word once
            put(f"{root}/stats-{at}", out.tobytes())
            found[5:] = [(out["cont"] == k).sum() for k in (1, 2, 3, 4)]
        return pa.table({"found": pa.array([found.tolist()], pa.list_(pa.int64()))})

    done = written(counted.groupBy("at").applyInArrow(merge, "found array<long>"), "lm-sums").collect()  # one row per range
    found = np.array([r["found"] for r in done], np.int64).reshape(-1, 9).sum(0)
    return found[:5], found[5:]


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more from count-of-counts 1 to 4."""
    n1, n2, n3, n4 = (int(x) for x in n)
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.75, 0.75, 0.75]) if n1 else np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))])


def score_texts(docs: DataFrame, folds: int = 10, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    root = scratch_path(spark, "lm")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_shards = 1 << max(0, (shards - 1).bit_length())
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = written(token_blocks(slim, folds), "lm-blocks")
    sizes = count_words(blocks, root, word_shards)
    words = _Words(root, sizes)
    vocabulary, tokens = int(words.base[-1]), sum(t for _, t in sizes)
    shards = max(shards, tokens // SHARD_TOKENS)
    totals, continued = word_stats(count_pairs(blocks, root, words, shards), root)
    high, low, types = discounts(totals[:4]), discounts(continued), int(totals[4])

    def stats(numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), STAT)
        part = numbers // RANGE
        by = np.argsort(part, kind="stable")
        for r, at in zip(*np.unique(part[by], return_index=True), strict=True):
            mine = by[at : at + int((part == r).sum())]
            try:
                out[mine] = mapped(f"{root}/stats-{r}", STAT)[numbers[mine] - r * RANGE]
            except FileNotFoundError:  # no pair has a word of this range
                continue
        return out

    def counts_of(keys: np.ndarray) -> np.ndarray:
        """Training counts of sorted pairs, from the mapped arrays."""
        out = np.zeros(len(keys), np.int64)
        for s, (mine, place) in _pack(_pair_shard(keys, shards), shards, keys, np.arange(len(keys))):
            try:
                model = mapped(f"{root}/pairs-{s}", "<u8")
            except FileNotFoundError:  # no pair has a hash of this shard
                continue
            at = np.minimum(np.searchsorted(model, mine), len(model) - 1)
            hit = model[at] == mine
            out[place[hit]] = _get_counts(f"{root}/pair-counts-{s}", at[hit])
        return out

    def scored(b: _Block) -> pa.RecordBatch:
        number, count = words.look(b.words)
        pair = b.pairs(number, vocabulary + 1)
        order = np.argsort(pair, kind="stable")
        first = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])
        seen = counts_of(pair[order][first])
        inverse = np.empty(len(pair), np.uint32)
        inverse[order] = np.cumsum(first) - 1
        del pair, order, first
        known = stats(np.append(number, vocabulary + 1))
        cont = known["cont"][:-1].astype(float)
        spare = low[1] * continued[0] + low[2] * continued[1] + low[3] * max(0, vocabulary - continued[0] - continued[1])
        lower = (np.maximum(cont - low[np.minimum(cont, 3).astype(int)], 0) + (spare / (vocabulary + 1) if types else 1 / (vocabulary + 1))) / (types or 1)
        gamma = known["n1"] * high[1] + known["n2"] * high[2] + known["n3"] * high[3]
        known_base = np.log10((count + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        code, total = b.codes, known["total"].astype(float)
        base, logs = known_base[code], np.empty(len(code))
        context = np.empty(len(code), np.uint32)
        context[1:] = code[:-1]
        context[b.begins] = len(number)
        for i in range(0, len(code), 65_536):  # by parts, so that few whole-block arrays are held
            at = slice(i, i + 65_536)
            c, low_p, t = seen[inverse[at]], lower[code[at]], total[context[at]]
            top = np.maximum(c - high[np.minimum(c, 3)], 0)
            logs[at] = np.log10(np.where(t > 0, (top + gamma[context[at]] * low_p) / np.maximum(t, 1), low_p))
        add = lambda x: np.add.reduceat(x, b.begins)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.held == 1), "n_tokens": pa.array(b.ends - b.begins), "n_known": pa.array(add((count[code] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(b.ids), tokens), pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(logs), pa.float64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield scored(_Block(row))

    scores = written(blocks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    discard(spark, blocks, root)
    return scores


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
