"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule over training time t in [0, 1], given as knots (t, weight) joined by
straight lines. Its mean is the source's weight. The words that a source has delivered by time t are its target
times the integral of its schedule up to t over the whole integral; inverting that function at the middle of a
document's place in the source's cumulative demand gives the document's training position. Sorting by position
(a range shuffle) yields the training order.

A source's documents stand in the order of a hash of doc_id. A target of q whole passes and a rest takes every
document q times and once more those whose middle lies within the rest, so a source's taken words miss its target
by at most half a document. Prefix sums are hierarchical: sums by (source, hash bucket), then running sums of
those, then running sums within a bucket; buckets grow with the root of the rows, so no source lands in one task.

Nulls: a null text has size 0; a null source is a source of its own, last in order; null doc_ids hash as empty
text. Repeated rows are separate documents. Documents of size 0 ride along with the passes at their place and take
0 words; a source without any word has target 0, takes part in no resharing and gives none. An empty table gives an empty result. Other columns are carried along
untouched; where a name is one that this operator adds, the column of the input gets underscores behind its name in mix_sources(), and the added
one in training_order().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.llm.common import bucket_bits, id_hash, words_count, written

Knots = Sequence[tuple[float, float]]

#: Means 5, 2 and 1: from easy bulk sources to rarer ones late in training.
CURRICULUM: tuple[Knots, ...] = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))


def mean_weight(knots: Knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def _invert(share: Column, knots: Knots) -> Column:
    """The time t by which the given share of the schedule's integral has passed."""
    whole, done, out = mean_weight(knots), 0.0, F.lit(1.0)
    parts = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        rest, slope = share * whole - done, (w1 - w0) / (t1 - t0)
        if slope:
            t = t0 + (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))) - w0) / slope
        else:
            t = t0 + rest / (w0 or 1.0)
        done += area
        parts.append((done / whole, t))
    for upto, t in reversed(parts):
        out = F.when(share <= upto, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """From (mx_src, mx_source_size): rank and target of each source.

    Targets are min(most * size, level * weight), where the level makes them add up to all words: what capped
    sources leave over is shared among the others by weight. The level is found from running sums over the sources
    in order of their caps per weight, which is what repeated resharing converges to.
    """
    ranked = sizes.withColumn("mx_rank", F.row_number().over(Window.orderBy("mx_src")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("mx_rank") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("mx_w", weight).withColumn("mx_cap", F.col("mx_source_size") * float(most))
    caps = caps.withColumn("mx_ratio", F.col("mx_cap") / F.col("mx_w"))
    before = Window.orderBy("mx_ratio", "mx_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("mx_source_size").over(every) - F.coalesce(F.sum("mx_cap").over(before), F.lit(0.0))) / (F.sum("mx_w").over(every) - F.coalesce(F.sum("mx_w").over(before), F.lit(0.0)))
    levels = caps.withColumn("mx_level", level)
    # sources fill up in order of their ratio; the level holds from the first source that stays below its cap
    levels = levels.withColumn("mx_level", F.min(F.when(F.col("mx_level") <= F.col("mx_ratio"), F.struct("mx_ratio", "mx_rank", "mx_level"))).over(every)["mx_level"])
    return levels.select("mx_src", "mx_rank", "mx_source_size", F.least("mx_cap", F.coalesce(F.col("mx_level") * F.col("mx_w"), F.col("mx_cap"))).alias("mx_target"))


def mix_sources(docs: DataFrame, size: Column | None = None, curriculum: Sequence[Knots] = CURRICULUM, most: float = 3.0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with mx_size, mx_source_size, mx_target, mx_copies, mx_taken and the numbers for mx positions.

    docs is read twice (sizes by bucket, then the rows themselves), so pass a table, not a long plan. size: an
    expression for a document's size, the words of docs.text unless given.
    """
    mixed = _mixed(docs, size, curriculum, most, id_col, source_col)
    names = {c: _free(c, [*ADDED, *(d for d in docs.columns if d != c)]) for c in docs.columns}
    return mixed.select(*[F.col("mx_row")[c].alias(n) for c, n in names.items()], *ADDED)


#: Columns that mix_sources() adds.
ADDED = ("mx_size", "mx_source_size", "mx_target", "mx_rank", "mx_start", "mx_hash", "mx_copies", "mx_taken")


def _free(name: str, others: Sequence[str]) -> str:
    """name with as many underscores behind it as make it differ from the others, whatever their case."""
    while name.lower() in {o.lower() for o in others}:
        name += "_"
    return name


def _mixed(docs: DataFrame, size: Column | None = None, curriculum: Sequence[Knots] = CURRICULUM, most: float = 3.0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """ADDED, and mx_row, which holds the row of docs, so that none of its names can clash."""
    bits = bucket_bits(docs.count())
    size = words_count(F.col("text")) if size is None else size
    based = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("mx_row"),
        size.alias("mx_size"),
        F.when(F.col(source_col).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("mx_src"),
        id_hash(F.col(id_col)).alias("mx_hash"), F.col(id_col).alias("mx_id"),
    ).withColumn("mx_bucket", F.shiftright("mx_hash", 60 - bits))
    sums = written(based.groupBy("mx_src", "mx_bucket").agg(F.sum("mx_size").alias("mx_sum")), "mix-sums")
    targets = source_targets(sums.groupBy("mx_src").agg(F.sum("mx_sum").alias("mx_source_size")), [mean_weight(k) for k in curriculum], most)
    before = Window.partitionBy("mx_src").orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("mx_src", "mx_bucket", F.coalesce(F.sum("mx_sum").over(before), F.lit(0)).alias("mx_base")).join(targets, "mx_src")
    starts = written(starts, "mix-starts")
    inside = Window.partitionBy("mx_src", "mx_bucket").orderBy("mx_hash", "mx_id", "mx_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = based.join(starts, ["mx_src", "mx_bucket"]).withColumn("mx_start", F.col("mx_base") + F.coalesce(F.sum("mx_size").over(inside), F.lit(0)))
    passes = F.coalesce(F.floor(F.try_divide("mx_target", "mx_source_size")), F.lit(0))
    rest = F.col("mx_target") - passes * F.col("mx_source_size")
    more = (F.col("mx_start") + F.col("mx_size") / 2 < rest).cast("long")
    placed = placed.withColumn("mx_copies", (passes + more).cast("long"))
    return placed.withColumn("mx_taken", F.col("mx_copies") * F.col("mx_size"))


def position(copy: Column, curriculum: Sequence[Knots] = CURRICULUM) -> Column:
    """Training position in [0, 1] of the given copy (from 0) of a row of mix_sources()."""
    demand = copy * F.col("mx_source_size") + F.col("mx_start") + F.col("mx_size") / 2
    share = F.coalesce(F.least(F.try_divide(demand, F.col("mx_target")), F.lit(1.0)), F.lit(0.0))
    kinds = [_invert(share, k) for k in curriculum]
    out = kinds[-1]
    for i in reversed(range(len(kinds) - 1)):
        out = F.when(F.col("mx_rank") % len(kinds) == i, kinds[i]).otherwise(out)
    return out


def training_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """Every copy that the mix takes, range-sorted by training position, with docs' columns and ``position``."""
    curriculum = options.get("curriculum", CURRICULUM)
    copies = _mixed(docs, **options).where("mx_copies > 0").withColumn("mx_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx_copies") - 1)))
    placed = copies.select("mx_row", position(F.col("mx_copy"), curriculum).alias("mx_position"), "mx_hash", "mx_copy")
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("mx_position", "mx_hash", "mx_copy")
    ordered = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return ordered.select(*[F.col("mx_row")[c].alias(c) for c in docs.columns], F.col("mx_position").alias(_free("position", docs.columns)))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents, with the training position of the first copy (null: not taken)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = written(docs.select("doc_id", "source", words_count(F.col("text")).alias("size")), "mix-sizes")
    mixed = _mixed(slim, size=F.col("size")).withColumn("doc_id", F.col("mx_row.doc_id"))
    first = F.when(F.col("mx_copies") > 0, position(F.lit(0)))
    out = mixed.select("doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), F.col("mx_taken").alias("taken"), first.alias("position"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "position", "doc_id").sortWithinPartitions("position", "doc_id")
