"""The path tree: missing parents, nesting rules, comparison of two trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.functions.paths import ancestors


def missing_parents(entries: DataFrame) -> DataFrame:
    """Directories that paths need and no entry lists."""
    needed = entries.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return needed.join(entries.select("path"), "path", "left_anti")


def nesting_violations(entries: DataFrame) -> DataFrame:
    """path, inside: entries that lie below something that is no directory."""
    below = entries.select("path", F.explode(ancestors(F.col("path"))).alias("inside"))
    return below.join(entries.where("type <> 1").select(F.col("path").alias("inside")), "inside").select("path", "inside")


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, status (only_left, only_right, changed) of two tables with path, type and hash."""
    a = left.select("path", F.struct("type", "hash").alias("l"))
    b = right.select("path", F.struct("type", "hash").alias("r"))
    status = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status IS NOT NULL")
