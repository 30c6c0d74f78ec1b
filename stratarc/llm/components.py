"""Connected components of an edge table, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Each round a node and its present root learn the smallest label among the node's neighbours, then labels jump
    to their label's label; paths shorten geometrically. Labels are written each round, so lineage stays short and both
    sides of every join are plain shuffles. Null ends are ignored. Stops when no label changes.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "cc-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b")
        seen = seen.join(labels.select(F.col("node").alias("a"), F.col("label").alias("mine")), "a").where("theirs < mine")
        offers = written(seen.select(F.col("mine").alias("node"), "theirs").union(seen.select(F.col("a").alias("node"), "theirs")).groupBy("node").agg(F.min("theirs").alias("theirs")), "cc-offers")
        if offers.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        hooked = written(labels.join(offers, "node", "left").select("node", F.least("label", F.coalesce("theirs", "label")).alias("label")), "cc-hooked")
        for _ in range(2):
            target = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
            hooked = written(hooked.join(target, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "cc-labels")
        labels = hooked
