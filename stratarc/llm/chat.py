r"""Chat formatting by a grammar round trip, in DataFrame operations only.

Grammar of the output: conversation = turn*, turn = "### " role ": " text "\n</turn>\n". A ``</turn>\n`` is live
unless a backslash precedes it, so a deterministic parser splits at the live ones, takes the role up to the first
": ", and undoes escapes: in texts one backslash less before every ``</turn>`` or ``###`` that has one, in roles
percent codes for ``%``, ``:``, ``<`` and newline.

Each turn is first rendered as it stands and parsed again. Where the parse differs from the source (the text holds
a live terminator, or something that looks escaped), the turn is escaped and parsed again. Then the whole
conversation is parsed and compared; if that differs, all its turns are escaped, and if it still differs the job
fails rather than write a wrong conversation. The loss mask lists (turn, start, length) in code points within the turns as parsed,
one span for each assistant turn's text, and nothing between.

Rows are ordered by turn, then role and text, nulls first; repeated rows are repeated turns. A null role or text counts as
empty; a null conv_id is a conversation of its own. Empty texts are kept as empty turns. An empty table gives an
empty result. Only the named columns are read, so other columns cannot clash. A conversation is assembled in one
row, after map-side collection, because its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE = r"(?<!\\)</turn>\n"
END = "\n</turn>\n"


#: Only from the head of a run of backslashes, and never giving any back: linear in runs of any length.
CONTROL = r"(\\*+)(</turn>|###)"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)" + CONTROL, r"\\$1$2")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\" + CONTROL, "$1$2")


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


CODES = [("%", "%25"), (":", "%3A"), ("<", "%3C"), ("\n", "%0A")]


def escape_role(role: Column) -> Column:
    return _replaced(role, CODES)


def unescape_role(role: Column) -> Column:
    return _replaced(role, [(b, a) for a, b in reversed(CODES)])


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), role, F.lit(": "), text, F.lit(END))


def segments(rendered: Column) -> Column:
    """The turns of a rendered conversation, each without its terminator; a null where the end is not a terminator."""
    parts = F.split(rendered, LIVE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1))


def _start(segment: Column) -> Column:
    """Code points of a segment before its text."""
    return F.locate(": ", segment) + 1


def parse_turn(segment: Column) -> Column:
    colon = F.locate(": ", segment)
    role = unescape_role(F.substring(segment, F.lit(5), colon - 5))
    return F.struct(role.alias("role"), unescape_text(_body(segment)).alias("text"))


def _body(segment: Column) -> Column:
    start = _start(segment)
    return F.substring(segment, start + 1, F.char_length(segment) - start - 1)


def parse(rendered: Column) -> Column:
    return F.transform(segments(rendered), parse_turn)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask array<struct<turn, start, length>>."""
    source = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("plain", render(F.col("role"), F.col("text"))).withColumn("safe", render(escape_role(F.col("role")), escape_text(F.col("text"))))
    alike = F.coalesce(parse(F.col("plain")) == F.array(F.struct("role", "text")), F.lit(False))
    # the escaped form is only kept where the plain one did not come back
    source = source.withColumn("piece", F.when(alike, F.col("plain")).otherwise(F.col("safe")))
    packed = source.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("turns"))
    want = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    second = F.array_join(F.transform("turns", lambda t: render(escape_role(t["role"]), escape_text(t["text"]))), "")
    tried = packed.select("conv_id", want.alias("want"), first.alias("first"), second.alias("second"))
    formatted = F.when(parse(F.col("first")) == F.col("want"), F.col("first")).when(parse(F.col("second")) == F.col("want"), F.col("second")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    mask = F.filter(
        F.transform(segments(F.col("formatted")), lambda s, i: F.struct(i.cast("long").alias("turn"), _start(s).cast("long").alias("start"), (F.char_length(s) - _start(s) - 1).cast("long").alias("length"), parse_turn(s)["role"].alias("role"))),
        lambda x: x["role"] == "assistant",
    )
    mask = F.transform(mask, lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length")))
    return tried.select("conv_id", formatted.alias("formatted")).withColumn("loss_mask", mask)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns from the formatted text and its mask alone."""
    cut = formatted.withColumn("segments", segments(F.col("formatted")))
    turns = F.transform("segments", parse_turn)
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_mask", lambda m: unescape_text(F.substring(F.element_at(F.col("segments"), (m["turn"] + 1).cast("int")), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return cut.withColumn("under", under).select(
        "conv_id", F.size("segments").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all conversations and conversation -7."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return read_back(format_conversations(turns.unionByName(extra)))
