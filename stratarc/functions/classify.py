"""File classes from names and first bytes: 0 compressible, 1 executable, 2 incompressible."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratarc.functions.paths import extension

SAMPLE = 65_536
#: Name ending of this engine's own archives, which are not packed again.
OWN_EXTENSION = "strat"

# These lists decide results and have to be as they are.
STORE_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "avif", "heic", "heif", "jxl", "mp4", "m4v", "mov", "mkv", "webm", "avi", "mp3", "m4a", "aac", "ogg", "oga",
    "opus", "flac", "zip", "gz", "tgz", "xz", "txz", "zst", "bz2", "tbz2", "lz4", "7z", "rar", "br", "jar", "apk", "ipa", "aab", "docx", "xlsx",
    "pptx", "odt", "ods", "odp", "epub", "woff", "woff2", "cab", "whl", "nupkg", "crx", "xpi", "lzma", "zipx",
)
TEXT_EXTENSIONS = (
    "txt", "md", "markdown", "rst", "c", "h", "cc", "cpp", "hpp", "cxx", "rs", "go", "py", "pyi", "js", "mjs", "cjs", "ts", "tsx", "jsx", "json",
    "html", "htm", "css", "scss", "less", "xml", "csv", "tsv", "log", "sql", "java", "kt", "swift", "rb", "php", "sh", "bash", "zsh", "yml", "yaml",
    "toml", "ini", "cfg", "conf", "svg", "tex", "vue", "svelte", "lua", "pl", "pm", "r", "m", "mm", "cs", "fs", "dart", "scala", "ex", "exs", "erl",
    "hs", "ml", "clj", "el", "vim", "gradle", "properties", "lock", "srt", "vtt", "po", "pot",
)
COMPRESSED_MAGIC = ("1F8B", "28B52FFD", "FD377A585A00", "377ABCAF271C", "52617221", "504B0304", "89504E47", "FFD8FF", "47494638", "4F676753", "664C6143")


def _byte(sample: Column, at: int | Column) -> Column:
    at = F.lit(at + 1) if isinstance(at, int) else at + 1
    return F.conv(F.hex(F.substring(sample, at, F.lit(1))), 16, 10).cast("int")


def _little(sample: Column, at: int | Column, n: int) -> Column:
    """Unsigned little-endian number of n bytes."""
    out = F.lit(0).cast("long")
    for i in range(n):
        out = out + _byte(sample, at + i).cast("long") * (1 << (8 * i))
    return out


def exec_transform(sample: Column) -> Column:
    """Transform for machine code, 0 for machines without one; null if it is no program."""
    size, head = F.octet_length(sample), F.hex(F.substring(sample, 1, 4))
    elf = F.when(_byte(sample, 5) == 2, _byte(sample, 18) * 256 + _byte(sample, 19)).otherwise(_byte(sample, 19) * 256 + _byte(sample, 18))
    elf = F.when(elf == 0x03, 1).when(elf == 0x3E, 4).when(elf == 0xB7, 2).otherwise(0)
    cpu = _little(sample, 4, 4)
    mach = F.when(cpu == 0x0100_0007, 4).when(cpu % (1 << 24) == 7, 1).when(cpu % (1 << 24) == 12, 2).otherwise(0)
    at = _little(sample, 0x3C, 4).cast("int")
    machine = _little(sample, at + 4, 2)
    pe = F.when(machine == 0x014C, 1).when(machine == 0x8664, 4).when(machine == 0xAA64, 2).otherwise(0)
    is_pe = (F.hex(F.substring(sample, 1, 2)) == "4D5A") & (size >= 0x40) & (at >= 0) & (at + 6 <= size) & (F.hex(F.substring(sample, at + 1, F.lit(4))) == "50450000")
    return F.when((head == "7F454C46") & (size >= 20), elf).when(head.isin("CFFAEDFE", "CEFAEDFE") & (size >= 8), mach).when(is_pe, pe)


def has_compressed_magic(sample: Column) -> Column:
    head = F.hex(F.substring(sample, 1, 12))
    out = (F.octet_length(sample) >= 12) & (F.substring(head, 9, 8) == "66747970")
    for magic in COMPRESSED_MAGIC:
        out = out | F.startswith(head, F.lit(magic))
    return out


@F.arrow_udf(T.BooleanType())
def looks_incompressible(sample: pa.Array) -> pa.Array:
    """Fast compression saves less than three in a hundred of a sample of at least 512 bytes."""
    import zstandard

    fast = zstandard.ZstdCompressor(level=1)
    data = sample.to_pylist()
    return pa.array([x is not None and len(x) >= 512 and len(fast.compress(x)) * 100 >= len(x) * 97 for x in data], pa.bool_())


def by_rules(path: Column, sample: Column, machine: Column | None = None) -> Column:
    """Class from cheap rules; null where only the probe can tell. machine: exec_transform(sample), if there already."""
    ext = extension(path)
    machine = exec_transform(sample) if machine is None else machine
    return F.when(machine.isNotNull(), 1).when(ext.isin(*STORE_EXTENSIONS, OWN_EXTENSION) | has_compressed_magic(sample), 2).when(ext.isin(*TEXT_EXTENSIONS), 0)


def classified(files: DataFrame, use_filters: bool = True) -> DataFrame:
    """files with class and transform, in one pass. Only samples of files that no rule settles reach the probe, which is Python; others are null there."""
    sample = F.substring(F.col("content"), 1, SAMPLE)
    ruled = files.withColumn("cl_machine", exec_transform(sample)).withColumn("cl_rule", by_rules(F.col("path"), sample, F.col("cl_machine")))
    probed = ruled.withColumn("cl_probe", looks_incompressible(F.when(F.col("cl_rule").isNull(), sample)))
    kind = F.coalesce("cl_rule", F.when(F.col("cl_probe"), 2).otherwise(0)).cast("short")
    transform = F.when(kind == 1, F.col("cl_machine")).otherwise(0) if use_filters else F.lit(0)
    return probed.withColumns({"class": kind, "transform": transform.cast("short")}).drop("cl_machine", "cl_rule", "cl_probe")
