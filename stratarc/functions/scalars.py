"""Formatting, encodings and small arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODECS = {0: "store", 1: "zstd", 2: "lzma2", 3: "context", 4: "context-fast", 5: "zstd-primed"}
TYPES = {0: "file", 1: "dir", 2: "symlink"}
TRANSFORMS = {0: "none", 1: "x86", 2: "arm64", 3: "x86-64", 4: "x86-64-split"}


def _named(value: Column, names: dict[int, str]) -> Column:
    out = F.concat(F.lit("unknown-"), value.cast("string"))
    for k, name in names.items():
        out = F.when(value == k, name).otherwise(out)
    return out


def codec_name(codec: Column) -> Column:
    return _named(codec, CODECS)


def type_name(kind: Column) -> Column:
    return _named(kind, TYPES)


def human(n: Column) -> Column:
    """Bytes with binary units: whole bytes below 1024, else two decimals, halves to the even one."""
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        # whole hundredths in integers: n = whole * size + rest, so nothing overflows
        size = F.lit(1024**power).cast("long")
        rest = (n % size) * 100
        down, over = F.floor(rest / size), (rest % size) * 2
        # floor() of a quotient of doubles is exact here: rest is below 100 * 2**40 and size a power of two
        hundredths = F.floor(n / size) * 100 + down
        hundredths = hundredths + F.when((over > size) | ((over == size) & (hundredths % 2 == 1)), 1).otherwise(0)
        whole = F.floor(hundredths / 100).cast("long")
        text = F.concat(whole.cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        out = F.when(n >= size, text).otherwise(out)
    return out


def grouped(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def percent(part: Column, whole: Column) -> Column:
    """part of whole in hundredths, to one decimal; null for a whole of 0."""
    return F.round(F.try_divide(part * 100.0, whole), 1)


def rate(size: Column, seconds: Column) -> Column:
    """Millions of bytes a second, to two decimals; null for no time."""
    return F.round(F.try_divide(size / 1e6, seconds), 2)


def civil(seconds: Column) -> Column:
    """Unix seconds as YYYY-MM-DD HH:MM in UTC (the session's zone has to be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def mtime_parts(nanoseconds: Column) -> Column:
    """Seconds rounded down and the rest, also for times before 1970."""
    rest = F.pmod(nanoseconds, F.lit(1_000_000_000))
    return F.struct(((nanoseconds - rest) / 1_000_000_000).cast("long").alias("mtime_s"), rest.cast("int").alias("mtime_ns"))


def zigzag(v: Column) -> Column:
    """Signed to unsigned; the result is to be read as an unsigned 64-bit number."""
    return F.shiftleft(v.cast("long"), 1).bitwiseXOR(F.shiftright(v.cast("long"), 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("long"))))


def varint_length(u: Column) -> Column:
    """Bytes of the shortest LEB128 form of an unsigned 64-bit number."""
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when((u >= 0) & (F.shiftrightunsigned(u, 7 * n) == 0), n).otherwise(out)
    return out


def varint_hex(u: Column) -> Column:
    """The shortest LEB128 form in lower-case hex."""
    last = varint_length(u) - 1
    digits = F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.lower(F.hex(_shifted(u, i).bitwiseAND(F.lit(127)).bitwiseOR(F.when(i < last, 128).otherwise(0)))), 2, "0"))
    return F.array_join(digits, "")


def _shifted(u: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", u, (i * 7).cast("int"))


def table_bits(n: Column) -> Column:
    """clamp(ceil(log2 n) + 1, 16, 24), exact for powers of two."""
    up = F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))
    return F.least(F.greatest(up + 1, F.lit(16)), F.lit(24))


def parse_hex(text: Column) -> Column:
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("long")


def permission(mode: Column) -> Column:
    return mode.bitwiseAND(0o777)


def octal(mode: Column) -> Column:
    return F.lpad(F.conv(mode.bitwiseAND(0o7777).cast("string"), 10, 8), 4, "0")
