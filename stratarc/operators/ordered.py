"""Order-dependent columns over a whole table without a single-task window.

Rows are range-partitioned once by the order and written with their partition's number. Within a partition plain windows do;
across partitions there is one row per partition, which is windowed and broadcast: its size is the number of
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratarc.operators.scratch import written


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """df with rg_part: partitions in the order's order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("rg_part", F.spark_partition_id()), "ranged")


def _inside(order: list[str]):
    return Window.partitionBy("rg_part").orderBy(*order)


def _across(per_part: DataFrame, value: Column, name: str) -> DataFrame:
    return F.broadcast(per_part.select("rg_part", value.alias(name)))


def running(df: DataFrame, order: list[str], value: Column, name: str, is_ranged: bool = False) -> DataFrame:
    """df with the sum of value over all preceding rows; order has to name unique keys for a defined result."""
    parts = df if is_ranged else ranged(df, order)
    parts = parts.withColumn("rg_value", value.cast("long"))
    sums = parts.groupBy("rg_part").agg(F.sum("rg_value").alias("s"))
    before = Window.orderBy("rg_part").rowsBetween(Window.unboundedPreceding, -1)
    base = _across(sums, F.coalesce(F.sum("s").over(before), F.lit(0)), "rg_base")
    own = F.coalesce(F.sum("rg_value").over(_inside(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.withColumn(name, own).join(base, "rg_part").withColumn(name, F.col(name) + F.col("rg_base")).drop("rg_value", "rg_base")
    return out if is_ranged else out.drop("rg_part")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a dense number from 0 in the given order."""
    return running(df, order, F.lit(1), name)


def previous(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with value of the row before, null in the first; value must not be null itself."""
    parts = ranged(df, order).withColumn("rg_value", value)
    last = parts.groupBy("rg_part").agg(F.max_by("rg_value", F.struct(*order)).alias("last"))
    base = _across(last, F.lag("last").over(Window.orderBy("rg_part")), "rg_last")
    seen = F.coalesce(F.lag("rg_value").over(_inside(order)), F.col("rg_last"))
    return parts.join(base, "rg_part").withColumn(name, seen).drop("rg_part", "rg_value", "rg_last")
