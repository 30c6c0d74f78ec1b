"""Selection from a catalog."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratarc.functions.paths import under


class NoMatch(ValueError):
    """A filter that selects nothing."""


def find(entries: DataFrame, path: str) -> DataFrame:
    """The entry with exactly this path; reaches the scan as a pushed filter."""
    return entries.where(F.col("path") == path)


def prefix_select(entries: DataFrame, filters: list[str], strict: bool = True) -> DataFrame:
    """Entries that equal or lie below any filter, once each; all for no filter. strict: each filter has to select something."""
    if not filters:
        return entries
    hits = [under(F.col("path"), F.lit(f)) for f in filters]
    if strict:
        found = entries.agg(*[F.coalesce(F.bool_or(h), F.lit(False)).alias(f"f{i}") for i, h in enumerate(hits)]).first()
        if missing := [f for f, there in zip(filters, found, strict=True) if not there]:
            raise NoMatch(f"no entry matches {missing[0]!r}")
    return entries.where(functools.reduce(operator.or_, hits))


def unmatched(entries: DataFrame, filters: DataFrame) -> DataFrame:
    """Filters (column filter) that select nothing."""
    exact = filters.withColumn("trimmed", F.regexp_replace("filter", "/+$", ""))
    hits = entries.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("trimmed")).distinct()
    return exact.join(hits, "trimmed", "left_anti").select("filter")
