"""Path predicates and projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the last component, ASCII lower case; none for names that begin with their only dot."""
    return F.translate(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)$", 1), _UPPER, _LOWER)


def is_valid(path: Column) -> Column:
    """1 to 4096 bytes, relative, no NUL or backslash, no empty or dot component, no colon in the first component."""
    parts = F.split(path, "/", -1)
    odd = F.exists(parts, lambda c: c.isin("", ".", ".."))
    return F.octet_length(path).between(1, 4096) & ~F.contains(path, F.lit("\0")) & ~F.contains(path, F.lit("\\")) & ~odd & ~F.contains(F.element_at(parts, 1), F.lit(":"))


def link_is_safe(path: Column, target: Column) -> Column:
    """Whether a relative link stays inside the tree: walks the target's components from the link's depth."""
    depth = F.size(F.split(path, "/")) - 1
    start = F.struct(depth.alias("depth"), F.lit(True).alias("ok"))

    def step(at: Column, part: Column) -> Column:
        up = part == ".."
        moved = F.when(up, at["depth"] - 1).when(part.isin("", "."), at["depth"]).otherwise(at["depth"] + 1)
        return F.struct(moved.alias("depth"), (at["ok"] & ~(up & (at["depth"] == 0))).alias("ok"))

    walked = F.aggregate(F.split(target, "/", -1), start, step, lambda at: at["ok"])
    return ~F.startswith(target, F.lit("/")) & ~F.contains(target, F.lit("\\")) & walked


def target_is_valid(target: Column) -> Column:
    return (F.octet_length(target) > 0) & ~F.contains(target, F.lit("\0"))


def under(path: Column, prefix: Column) -> Column:
    """path equals prefix or lies below it; a trailing slash of prefix doesn't matter."""
    trimmed = F.regexp_replace(prefix, "/+$", "")
    return (path == trimmed) | F.startswith(path, F.concat(trimmed, F.lit("/")))


def ancestors(path: Column) -> Column:
    """All proper ancestors, outermost first."""
    parts = F.split(path, "/")
    whole = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    return F.slice(whole, F.lit(1), F.size(parts) - 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1
