"""Exact top-k inner-product search by ball trees with branch and bound.

Vectors are quantised to floor(scale * x) and scored by integer inner products, so results are exact. Each shard of
rows is made into a ball tree (nodes: center, radius, range of rows), stored as one row. Trees stay where they are: queries, a stated share of all
rows, come to them in chunks of at most CHUNK values (32 MB), so neither vectors nor trees are ever shuffled; for every chunk each tree is read twice. The first pass
takes every query down the most promising leaf of every tree; the k-th best score over all trees is a bar that all shards share. The second pass searches:
nodes are taken in the order of their upper bound q.c + |q| r, nodes whose bound lies under a query's present k-th score are cut for that query, and
surviving leaves are scored by a matrix product. A task hands its present k-th scores on from tree to tree and returns at most k rows a query. Equal
bounds are kept, so ties go to the smaller vec_id exactly.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part. A query's own id is no candidate, in
whatever row. Rows that repeat an id and a vector are separate candidates and are asked once. Vectors are compared with those of their own
length. Fewer than k candidates give fewer rows; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratarc.llm.common import frugal, written

SHARD = 8192
LEAF = 128
#: Values of query vectors that go to the workers at once, and queries that a tree is searched for at once.
CHUNK, QUERIES = 4_000_000, 1024
_TREE_SQL = "dim int, n int, ids binary, kind string, vectors binary, lows binary, highs binary, centers binary, radii binary, left binary"


def build_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, ...]:
    """Row order, and per node: first row, end row, center, radius, left child (0: a leaf; the right one follows it)."""
    order = np.arange(len(vectors))
    nodes: list[list] = [[0, len(vectors), 0]]
    centers, radii = [], []
    i = 0
    while i < len(nodes):
        lo, hi, _ = nodes[i]
        own = vectors[order[lo:hi]]
        center = own.mean(0)
        far = np.sqrt(((own - center) ** 2).sum(1))
        centers.append(center)
        # widened a little, so that rounding can't make a bound too low
        radii.append(float(far.max()) * (1 + 1e-9) + 1e-6 if len(far) else 0.0)
        if hi - lo > leaf and far.max() > 0:
            a = own[far.argmax()]
            b = own[((own - a) ** 2).sum(1).argmax()]
            along = own @ (b - a)
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(along, mid)]
            nodes[i][2] = len(nodes)
            nodes += [[lo, lo + mid, 0], [lo + mid, hi, 0]]
        i += 1
    table = np.array(nodes, np.int64)
    return order, table[:, 0], table[:, 1], np.array(centers), np.array(radii), table[:, 2]


def _vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, quantised vectors) of the rows that take part."""
    lists, ids = batch.column("embedding"), batch.column("vec_id")
    ok = np.array([i is not None for i in ids.to_pylist()]) & np.array(lists.is_valid())
    lengths = np.where(ok, np.nan_to_num(np.array(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), float)), -1).astype(int)
    for dim in sorted({int(d) for d in lengths if d >= 0}):
        mine = np.flatnonzero(lengths == dim)
        flat = lists.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(mine), dim)
        fine = np.isfinite(flat).all(1)
        yield dim, ids.take(pa.array(mine[fine])).to_numpy(zero_copy_only=False).astype(np.int64), np.floor(scale * flat[fine])


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(values).max(initial=0)
    return np.ascontiguousarray(values.astype("<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<f8"))


def shards_of(rows: DataFrame, scale: float, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order, *tree = build_tree(vectors)
            small = _small(vectors[order])
            data = [ids[order], small.dtype.str, small, *tree]
            cells = [pa.array([x], pa.string()) if isinstance(x, str) else pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in data]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), *cells], names=[f.split()[0] for f in _TREE_SQL.split(", ")])

        for batch in batches:
            for dim, ids, vectors in _vectors(batch, scale):
                for i in range(0, len(ids), size):
                    held.setdefault(dim, []).append((ids[i : i + size], vectors[i : i + size]))
                    if sum(len(x) for x, _ in held[dim]) >= size:
                        yield out(dim)
        for dim in list(held):
            if sum(len(x) for x, _ in held[dim]):
                yield out(dim)

    return rows.mapInArrow(run, _TREE_SQL)


class Tree:
    def __init__(self, dim: int, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), dim).astype(np.float64)
        self.lows, self.highs, self.left = (np.frombuffer(row[n], "<i8") for n in ("lows", "highs", "left"))
        self.radii = np.frombuffer(row["radii"], "<f8")
        self.centers = np.frombuffer(row["centers"], "<f8").reshape(len(self.radii), dim)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds [queries, nodes] of inner products."""
        reach = np.sqrt((queries**2).sum(1))[:, None] * self.radii
        dot = queries @ self.centers.T
        return dot + reach + 1e-9 * np.abs(dot) + 1e-6

    def search(self, best: Best, mine: slice, only_first: bool) -> None:
        """Put this tree's best for some of the queries into best, by branch and bound."""
        queries = best.queries[mine]
        upper = self.bounds(queries)

        def take(node: int, who: np.ndarray) -> None:
            lo, hi = int(self.lows[node]), int(self.highs[node])
            best.offer(who + mine.start, self.ids[lo:hi], queries[who] @ self.vectors[lo:hi].T)

        bar = best.bar[mine]  # a view: it rises as leaves are taken
        leaves = np.flatnonzero(self.left == 0)
        first = leaves[upper[:, leaves].argmax(1)]
        for node in np.unique(first):
            who = np.flatnonzero(first == node)
            if len(who := who[upper[who, node] >= bar[who]]):
                take(int(node), who)
        if only_first:
            return
        # nodes by their best bound; children are reached only through nodes that some query can't cut
        heap = [(-float(upper[:, 0].max()), 0, np.arange(len(queries)))]
        while heap:
            _, node, who = heapq.heappop(heap)
            who = who[upper[who, node] >= bar[who]]
            if not len(who):
                continue
            if child := int(self.left[node]):
                for c in (child, child + 1):
                    heapq.heappush(heap, (-float(upper[who, c].max()), c, who))
            elif len(who := who[first[who] != node]):
                take(node, who)


class Best:
    """The k best candidates so far of every query, in order, and the scores that new ones have to reach."""

    def __init__(self, q_ids: np.ndarray, queries: np.ndarray, k: int, bar: np.ndarray | None = None) -> None:
        self.q_ids, self.queries, self.k = q_ids, queries, k
        self.ids, self.scores = np.zeros((len(q_ids), k), np.int64), np.full((len(q_ids), k), -np.inf)
        self.bar = np.full(len(q_ids), -np.inf) if bar is None else bar.copy()

    def offer(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores >= self.bar[who][:, None]) & (ids != self.q_ids[who][:, None])
        rows = np.flatnonzero(good.any(1))
        if not len(rows):
            return
        who, good = who[rows], good[rows]
        s = np.concatenate([self.scores[who], np.where(good, scores[rows], -np.inf)], 1)
        i = np.concatenate([self.ids[who], np.broadcast_to(ids, good.shape)], 1)
        for by_id in (True, False):  # by id, then by score: ties stay in order of id
            order = np.argsort(i if by_id else -s, 1, kind="stable")
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.scores[who], self.ids[who] = s[:, : self.k], i[:, : self.k]
        self.bar[who] = np.maximum(self.bar[who], self.scores[who, -1])

    def rows(self, dim: int) -> pa.RecordBatch:
        place, rank = np.nonzero(self.scores > -np.inf)
        data = (np.full(len(place), dim, np.int32), place, self.q_ids[place], self.ids[place, rank], self.scores[place, rank].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=["dim", "place", "query_id", "vec_id", "score"])


def _search(trees: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, bars: dict[int, np.ndarray] | None) -> DataFrame:
    """The best of each task's trees for all queries of a chunk; without bars, of one leaf a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        found: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if (dim := row["dim"]) not in asked:
                    continue
                tree = Tree(dim, row)
                best = found.setdefault(dim, Best(*asked[dim], k, bars and bars[dim]))
                for q in range(0, len(best.q_ids), QUERIES):
                    tree.search(best, slice(q, q + QUERIES), bars is None)
        for dim, best in found.items():
            yield best.rows(dim)

    return trees.mapInArrow(run, "dim int, place long, query_id long, vec_id long, score long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query."""
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    trees = written(shards_of(pick(rows), scale, SHARD), "topk-trees")
    every = written(pick(queries).where("vec_id IS NOT NULL AND embedding IS NOT NULL").distinct(), "topk-queries")
    chunks = max(1, -(-(every.agg(F.sum(F.size("embedding"))).first()[0] or 0) // CHUNK))
    out = None
    for c in range(chunks):
        parts: dict[int, list] = {}
        for batch in every.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toArrow().to_batches():  # about CHUNK values
            for dim, ids, vectors in _vectors(batch, scale):
                parts.setdefault(dim, []).append((ids, vectors))
        asked = {dim: tuple(np.concatenate(x) for x in zip(*p, strict=True)) for dim, p in parts.items()}
        first = written(_search(trees, asked, k, None), "topk-first")
        nth = F.row_number().over(Window.partitionBy("dim", "place").orderBy(F.desc("score")))
        bars = {dim: np.full(len(ids), -np.inf) for dim, (ids, _) in asked.items()}
        for r in first.select("dim", "place", "score", nth.alias("r")).where(F.col("r") == k).collect():  # one row a query of the chunk
            bars[r["dim"]][r["place"]] = r["score"]
        found = written(_search(trees, asked, k, bars), "topk-found")
        rank = F.row_number().over(Window.partitionBy("dim", "place").orderBy(F.desc("score"), "vec_id")).cast("int")
        ranked = found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def op9_topk(spark, sf_dir: str) -> DataFrame:
    """Contract columns: queries are the rows whose vec_id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 20 = 0"))
