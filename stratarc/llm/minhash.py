"""MinHash near-duplicate detection with tensored banding, links verified on full shingle sets.

Sketch: two collections of m small minhash groups. A table key is a pair of groups, one from each collection, so m * m
tables of 2 * ROWS minhashes each come from only 2 * m * ROWS minhashes. With ROWS = 3 and m = 11 a pair with
similarity 0.85 misses all 121 tables with probability 6e-5.

1. Equal shingle sets collapse to one representative, the smallest doc_id.
2. Buckets: map tasks sort the keys of a block of documents; members of a bucket are linked to its smallest document
   there, and only that one goes on to the key's shard, where the same is done across blocks. So a bucket of any size
   gives one candidate link per member and no task sees more than one row per block of a hot bucket.
3. Each document's most frequent candidate is verified on the full sets; verified links form components.
4. Components that share a bucket form a cluster. Its core C are the shingles that most members have, its family those members that differ
   from C less than from nothing. Within it each set A becomes its difference S from the core.
   As the difference of A and B is that of their S, they are alike enough exactly if
   K(A) + K(B) <= 2 (100 + percent) |S(A) and S(B)|, where K = (100 + percent) |S| - (100 - percent) |A|. So whatever the sets:
   a. every two members with K(A) + K(B) <= 0 are linked through the member of smallest K, with which each member is verified,
      as it is with the member of smallest K that shares most of the difference;
   b. any other two need so many differences in common that they share one of the rarest of each (a prefix filter), and differences that no
      other member has count for none. What sizes and places in the order leave possible is verified, without a cap.
   Near copies of one text have few differences from the core, most of them their own, so few pairs are left. Whoever is no nearer to C than
   to nothing can only be alike to sets with |S| >= (2 percent / 100 - 1) |A|. All these go on to another round with a core of their own;
   after FAMILIES rounds, or when no core is left, the rest are paired by the same filter on the sets themselves. So no link between
   members of a cluster is lost. Pairs inside a component need no check: they can't change the result.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles are five words; a text with fewer words is one shingle.
Null and empty texts have no shingles and link with nothing. Null doc_ids are never linked (component null, kept). Rows that
share a doc_id are one node; each is returned. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarc.llm.common import discard, frugal, hash_words, mix64, split_words, written
from stratarc.llm.components import components
from stratarc.llm.tokens import text_slices

WORDS = 5
ROWS = 3
BLOCK = 2_048
#: Text bytes that are split into words at once.
SLICE = 2_000_000
#: Keys that a shard holds in the mean.
SHARD_KEYS = 1_000_000
#: Rounds of cores before sets are paired as they are.
FAMILIES = 2
#: Rows up to which ids and set keys (some 60 bytes a row on the JVM), and numbers up to which cores, are broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    unique, codes, ends = split_words(texts, lower=True)
    h = hash_words(unique)[codes]
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = len(h) - WORDS + 1
    if n > 0:
        s = h[:n].copy()
        for k in range(1, WORDS):
            s *= _P
            s += h[k : k + n]
        s = mix64(s)
    out = []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b >= WORDS:
            out.append(np.unique(s[b : e - WORDS + 1]))
        elif e > b:
            short = np.array([e - b], np.uint64)
            for k in range(b, e):
                short = mix64(short * _P + h[k : k + 1])
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray], count: int, chunk: int = 32_768) -> np.ndarray:
    """[len(sets), count] uint32; rows of empty sets are 0."""
    rng = np.random.default_rng(20240607)
    mul = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 2**63, count, dtype=np.uint64)
    out = np.zeros((len(sets), count), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    start = 0
    while start < len(full):
        stop, n = start, 0
        while stop < len(full) and (stop == start or n + len(sets[full[stop]]) <= chunk):
            n += len(sets[full[stop]])
            stop += 1
        part = full[start:stop]
        u = np.concatenate([sets[i] for i in part])
        at = np.cumsum([0] + [len(sets[i]) for i in part[:-1]])
        buf = np.empty_like(u)
        for j in range(count):
            np.bitwise_xor(u, xor[j], out=buf)
            np.multiply(buf, mul[j], out=buf)
            out[part, j] = np.minimum.reduceat(buf, at) >> np.uint64(32)
        start = stop
    return out


def _set_key(s: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame, m: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set), sig (minhashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text"))
                sig = minhashes(sets, 2 * m * ROWS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def table_keys(sig: np.ndarray, m: int) -> np.ndarray:
    """[docs, m * m] uint64 keys of all tables: pairs of groups from the two collections."""
    groups = sig.reshape(len(sig), 2, m, ROWS).astype(np.uint64)
    h = np.zeros(groups.shape[:3], np.uint64)
    for k in range(ROWS):
        h = mix64(h * _P + groups[..., k] + np.uint64(k + 1))
    table = np.arange(m * m, dtype=np.uint64).reshape(1, m, m) * _P
    return mix64(h[:, 0, :, None] * np.uint64(0xD6E8FEB86659FD93) + h[:, 1, None, :] + table).reshape(len(sig), m * m)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in order of key then id, the first of each run, and (member, center) of runs of several."""
    order = np.lexsort((ids, keys))
    k, v = keys[order], ids[order]
    first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    center = v[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(k) else v
    member = center != v
    return order, first, v[member], center[member]


def _counted(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch | None:
    if not len(a):
        return None
    pairs, n = _pair_counts(a, b)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), -1), pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n, pa.int64()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], schema=_EDGE)


def _pair_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = np.flatnonzero(first)
    return np.stack([a[at], b[at]], 1), np.diff(np.concatenate([at, [len(a)]]))


_EDGE = pa.schema([("shard", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])
_EDGE_SQL = "shard int, a long, b long, n long, keys binary, ids binary"


def candidate_stars(reps: DataFrame, m: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, n): document a shares n buckets with b, which is the smallest in them (of a's block or of all); and the scratch table that it reads."""

    def of_block(ids: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = table_keys(sig, m)
        flat, owner = keys.reshape(-1), np.repeat(ids, m * m)
        order, first, a, b = _stars(flat, owner)
        if (edges := _counted(a, b)) is not None:
            yield edges
        lead = np.sort(order[first])  # by document again: ids then compress well
        flat, owner = flat[lead], owner[lead]
        shard = (flat >> np.uint64(32)) % np.uint64(shards)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        rows = [(s, by[cuts[s] : cuts[s + 1]]) for s in range(shards) if cuts[s] < cuts[s + 1]]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), none, none, none, pa.array([(flat[x] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for _, x in rows], pa.binary()), pa.array([owner[x].astype("<i8").tobytes() for _, x in rows], pa.binary())], schema=_EDGE)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        ids, sigs, n = [], [], 0
        for batch in batches:
            ids.append(batch.column("rep").to_numpy(zero_copy_only=False).astype(np.int64))
            sigs.append(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, 2 * m * ROWS))
            n += batch.num_rows
            if n >= BLOCK:
                yield from of_block(np.concatenate(ids), np.concatenate(sigs))
                ids, sigs, n = [], [], 0
        if n:
            yield from of_block(np.concatenate(ids), np.concatenate(sigs))

    def merged(table: pa.Table) -> pa.Table:
        frugal()
        keys = np.frombuffer(b"".join(x for x in table.column("keys").to_pylist() if x is not None), "<u4")
        ids = np.frombuffer(b"".join(x for x in table.column("ids").to_pylist() if x is not None), "<i8")
        _, _, a, b = _stars(keys, ids)
        batch = _counted(a, b)
        empty = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _EDGE], schema=_EDGE)
        return pa.Table.from_batches([batch if batch is not None else empty]).select(["a", "b", "n"])

    local = written(reps.select("rep", "sig").mapInArrow(blocks, _EDGE_SQL), "minhash-buckets")
    across = local.where("shard >= 0").select("shard", "keys", "ids").groupBy("shard").applyInArrow(merged, "a long, b long, n long")
    return local.where("shard < 0").select("a", "b", "n").unionByName(across), local


def full_sets(docs: DataFrame, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, n, diff): the whole sets of the given representatives, from their texts; diff is the set itself."""
    needed = written(reps.select("rep", "set_key").join(ids, "rep", "left_semi"), "minhash-needed")
    small = needed.count() <= BROADCAST_ROWS
    keys = needed.select(F.col("rep").alias("doc_id"))
    some = docs.join(F.broadcast(keys) if small else keys, "doc_id", "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "set_key", "n", "diff"])

    sets = some.mapInArrow(full, "rep long, set_key binary, n long, diff binary")
    # an id whose rows differ in text has several sets; the representative's is the one meant
    return written(sets.join(F.broadcast(needed) if small else needed, ["rep", "set_key"], "left_semi").dropDuplicates(["rep"]).select("rep", "n", "diff"), "minhash-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) with 100 * |intersection| >= percent * |union|.

    sets has each set's size and its difference from a core, which is the same for both sets of a pair, or empty:
    what sets A and B don't share is what their differences don't share, so the sizes of intersection and union are exact.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            keep = []
            for x, y, n in zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist(), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                # both are sorted: matches by binary search of the shorter in the longer
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                at = np.searchsorted(t, s)
                same = int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(s) else 0
                both = (n - (len(s) + len(t) - 2 * same)) // 2
                keep.append(100 * both >= percent * (n - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda end, diff, n: sets.select(F.col("rep").alias(end), F.col("diff").alias(diff), F.col("n").alias(n))
    joined = pairs.select("a", "b").join(side("b", "y", "nb"), "b").join(side("a", "x", "na"), "a")
    return joined.select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(compare, "a long, b long")


def _each_shingle(sets: DataFrame) -> DataFrame:
    """(cluster, rep, shingle): a row for each member of diff."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                data = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("diff")]
                who = pa.array(np.repeat(np.arange(len(data)), [len(d) for d in data]))
                yield pa.RecordBatch.from_arrays([part.column("cluster").take(who), part.column("rep").take(who), pa.array(np.concatenate(data))], names=["cluster", "rep", "shingle"])

    return sets.select("cluster", "rep", "diff").mapInArrow(each, "cluster long, rep long, shingle long")


def _core_differences(sets: DataFrame) -> DataFrame:
    """sets (cluster, rep, n, diff) with diff taken to the cluster's core, the shingles that more than half of its members have, and the core's size c."""
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("members"))
    counted = written(_each_shingle(sets).groupBy("cluster", "shingle").agg(F.count("*").alias("holders")).where("holders > 1"), "minhash-holders")
    core = counted.join(sizes, "cluster").where("2 * holders > members").groupBy("cluster").agg(F.sort_array(F.collect_list("shingle")).alias("core"))
    core = written(core, "minhash-core")
    small = (core.agg(F.sum(F.size("core"))).first()[0] or 0) <= BROADCAST_ROWS

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            out, sizes = [], []
            for x, c in zip(batch.column("diff"), batch.column("core"), strict=True):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                if c.is_valid:
                    own = np.setxor1d(own, c.values.to_numpy(zero_copy_only=False).view(np.uint64), assume_unique=True)
                out.append(own.tobytes())
                sizes.append(len(c) if c.is_valid else 0)
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("rep"), batch.column("n"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["cluster", "rep", "n", "c", "diff"])

    joined = sets.join(F.broadcast(core) if small else core, "cluster", "left")
    return written(joined.select("cluster", "rep", "n", "diff", "core").mapInArrow(taken, "cluster long, rep long, n long, c long, diff binary"), "minhash-differences")


def cluster_links(sets: DataFrame, labels: DataFrame, cross: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, among which are enough to join all that any link inside a cluster joins.

    labels: (rep, component); cross: (ca, cb), components that share a bucket.
    """
    clusters = components(cross.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    members = written(labels.join(clusters, "component"), "minhash-members")
    now, links = members.select("rep", "component"), []
    todo = written(sets.join(members.select("rep", "cluster"), "rep").select("cluster", "rep", "n", "diff"), "minhash-clustered")
    for _ in range(FAMILIES):
        diffs = _core_differences(todo)
        far = F.octet_length("diff") / 8
        family = written(diffs.where(far < F.col("n")), "minhash-family")
        if family.isEmpty():
            break
        found, now = _family_links(family, now, percent)
        links.append(found)
        rest = diffs.where(far * 100 >= F.col("n") * (2 * percent - 100)).select("cluster", "rep")
        several = rest.groupBy("cluster").agg(F.count("*").alias("members")).where("members > 1").select("cluster")
        todo = written(todo.join(written(rest.join(several, "cluster"), "minhash-rest").select("rep"), "rep"), "minhash-todo")
    found, _ = _family_links(todo.withColumn("c", F.lit(0).cast("long")), now, percent)
    for more in links:
        found = found.unionByName(more)
    return found


def _family_links(diffs: DataFrame, now: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Steps a and b for sets (cluster, rep, n, c, diff) of one core a cluster: links, and (rep, component) of all after step a."""
    spark = diffs.sparkSession
    each = written(_each_shingle(diffs), "minhash-each")
    held = written(each.groupBy("cluster", "shingle").agg(F.count("*").alias("holders")).where("holders > 1"), "minhash-shared")
    rows = written(each.join(held, ["cluster", "shingle"]), "minhash-rows")
    discard(spark, each, held)
    shared = rows.groupBy("rep").agg(F.count("*").alias("shared"))
    excess = F.octet_length("diff").cast("long") / 8 * (100 + percent) - F.col("n") * (100 - percent)
    facts = diffs.select("cluster", "rep", "n", "c", excess.cast("long").alias("k")).join(shared, "rep", "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    facts = written(facts.join(now, "rep"), "minhash-facts")

    unit = 2 * (100 + percent)
    sizes = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    room = f"ka + kb <= {unit} * least(sa, sb) AND {sizes}"
    side = lambda x: [F.col("rep").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}"), F.col("shared").alias(f"s{x}")]
    least = F.min(F.struct("k", "rep", "component", "n", "shared")).alias("h")
    hub = [F.col("h.rep").alias("b"), F.col("h.component").alias("cb"), F.col("h.n").alias("nb"), F.col("h.k").alias("kb"), F.col("h.shared").alias("sb")]

    # a. with the member of smallest k of the cluster, and of all that share a difference
    hubs = written(facts.groupBy("cluster").agg(least).select("cluster", *hub), "minhash-hubs")
    pairs = facts.select("cluster", *side("a")).join(hubs, "cluster").where(f"ca <> cb AND {room}").select("a", "b")
    known = written(rows.select("cluster", "shingle", "rep").join(facts.drop("cluster"), "rep"), "minhash-known")
    local = written(known.groupBy("cluster", "shingle").agg(least).select("cluster", "shingle", *hub), "minhash-local-hubs")
    near = known.select("cluster", "shingle", *side("a")).join(local, ["cluster", "shingle"]).where(f"ca <> cb AND {room}")
    near = near.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    links = written(verified(written(pairs.union(near).distinct(), "minhash-hub-pairs"), diffs, percent), "minhash-hub-links")

    # b. the components of now, then all other pairs by the prefix filter
    ends = links.join(now.select(F.col("rep").alias("a"), F.col("component").alias("ca")), "a").join(now.select(F.col("rep").alias("b"), F.col("component").alias("cb")), "b")
    merged = components(written(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "minhash-merged"))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    now = written(now.join(merged, "component", "left").select("rep", F.coalesce("whole", "component").alias("component")), "minhash-now")
    facts = written(facts.drop("component").join(now, "rep"), "minhash-facts")
    # smallest k in any other component: of the component that has the smallest one, and of the rest
    first = facts.groupBy("cluster").agg(F.min(F.struct("k", "component")).alias("h")).select("cluster", F.col("h.k").alias("k1"), F.col("h.component").alias("c1"))
    first = written(first, "minhash-first")
    second = facts.join(first, "cluster").where("component <> c1").groupBy("cluster").agg(F.min("k").alias("k2"))
    lows = written(first.join(second, "cluster"), "minhash-lows")  # clusters of a single component are settled
    other = F.when(F.col("component") == F.col("c1"), F.col("k2")).otherwise(F.col("k1"))
    # a set of x shingles differs from a core of c by |x - c| at least; of the sizes that can go with n, that nearest to c has the least k
    near_size = F.greatest(F.least(F.col("c").cast("double"), F.col("n") * 100 / percent), F.col("n") * percent / 100)
    other = F.greatest(other, F.floor(F.abs(near_size - F.col("c")) * (100 + percent) - near_size * (100 - percent) - 0.01))
    # at least one: whoever needs none in common with a member of another component is linked already
    need = F.greatest(F.ceil((F.col("k") + other) / unit), F.lit(1))
    open_ = facts.join(lows, "cluster").withColumn("keep", F.col("shared") - need + 1).where("keep > 0").select("rep", "component", "n", "k", "shared", "keep")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("holders", "shingle"))
    prefix = rows.join(written(open_, "minhash-open"), "rep").withColumn("rank", rank).where("rank <= keep").drop("keep", "holders")
    prefix = written(prefix, "minhash-prefix")
    mixed = prefix.groupBy("cluster", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("cluster", "shingle")
    last = written(prefix.join(mixed, ["cluster", "shingle"], "left_semi"), "minhash-last")
    x, y = (last.select("cluster", "shingle", *side(end), F.col("rank").alias(f"r{end}")) for end in "ab")
    # where the first difference in common stands so late that too few can follow, there is no link
    follow = f"ka + kb <= {unit} * (1 + least(sa - ra, sb - rb)) AND {sizes}"
    pairs = written(x.join(y, ["cluster", "shingle"]).where(f"ca < cb AND {follow}").select("a", "b").distinct(), "minhash-pairs")
    found = written(verified(pairs, diffs, percent), "minhash-pair-links")
    discard(spark, rows, known, local, prefix, last, pairs)
    return links.unionByName(found), now


def _labels(ends: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, component) of all ends."""
    return written(ends.join(components(links), "node", "left").select(F.col("node").alias("rep"), F.coalesce("component", "node").alias("component")), "minhash-labels")


def near_duplicates(docs: DataFrame, percent: int = 80, m: int | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    m = m or (11 if percent >= 85 else 14)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = written(sketches(docs, m), "minhash-sketches")
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every.count() * m * m // SHARD_KEYS))
    able = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(able.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "minhash-reps")
    copies = able.select("doc_id", "set_key").join(reps.select("rep", "set_key"), "set_key").where("doc_id <> rep")
    copies = written(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "minhash-copies")

    stars, buckets = candidate_stars(reps, m, shards)
    stars = written(stars.groupBy("a", "b").agg(F.sum("n").alias("n")), "minhash-stars")
    discard(spark, buckets)
    best = written(stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b")), "minhash-best")
    ends = written(stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct(), "minhash-ends")
    sets = full_sets(docs, ends.select(F.col("node").alias("rep")), reps)
    links = written(verified(best, sets, percent), "minhash-links")
    labels = _labels(ends, links)
    one = labels.select(F.col("rep").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
    cross = written(stars.join(one, "a").join(two, "b").where("ca <> cb").select("ca", "cb").distinct(), "minhash-cross")
    if not cross.isEmpty():
        links = links.unionByName(cluster_links(sets, labels, cross, percent))
    found = written(components(links.unionByName(copies)), "minhash-components")
    discard(spark, sets, stars, reps)
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    joined = every.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_shingles", label.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the rows of the smallest doc_id stay; docs' own columns."""
    gone = written(near_duplicates(docs, percent, id_col=id_col, text_col=text_col).where("NOT kept").select(F.col("doc_id").alias("nd_id")).distinct(), "minhash-gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["nd_id"], "left_anti").select(*docs.columns)


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents, at 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
