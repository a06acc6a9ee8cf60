"""Chat formatting in budgeted windows.

The turns of a conversation get prefix sums of their tokens. A turn belongs to
the span in which its prefix sum ends, spans being equal slices of the token
line; so spans are turn-aligned and depend on prefix sums alone. A window is
the conversation's system turn, the turns at the end of the span before it
(limited history) and the span's own turns. Where a long turn leaves the span
before it empty, the history is that of the turns right before it. Only the assistant texts of the
span's own turns are targets: repeated ones are masked, so each assistant text
is under the loss once over all windows.

Prefix sums are made in two levels, of blocks of turns and within a block, so
that a conversation of any length is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import require

# The template's marks, and the strings that models of this kind read as control.
OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: Text in a turn never holds one of these: (string, its escape), undone in the opposite order.
ESCAPES = (
    ("&", "&amp;"),
    ("<|", "&lt;|"),
    ("<s>", "&lt;s>"),
    ("</s>", "&lt;/s>"),
    ("<<SYS>>", "&lt;<SYS>>"),
    ("<</SYS>>", "&lt;</SYS>>"),
    ("[INST]", "&#91;INST]"),
    ("[/INST]", "&#91;/INST]"),
)


def escape(text: Column) -> Column:
    for plain, spelled in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(spelled))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: after it every ``&`` begins one of three entities."""
    for spelled, plain in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(spelled), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def turn_tokens(text: Column) -> Column:
    """Budgeted tokens of a turn: a quarter of its bytes, rounded up, and four for its marks."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def before_long_turns(summed: DataFrame, span_tokens: int, history_tokens: int) -> DataFrame:
    """The history of windows whose first own turn leaves the span before them empty.

    Only a turn of more than ``span_tokens`` does. Its history is the turns
    before it that have at most ``history_tokens`` tokens together. They end in
    the slice of ``history_tokens`` in which the long turn begins or in the one
    before it, so the join is on slices and meets few turns in each.
    """
    size = max(1, history_tokens)
    begin = F.col("end") - F.col("tokens")
    long_turns = (
        summed.where((F.col("tokens") > span_tokens) & (begin > 0))
        .select(F.col("conv_id").alias("c"), begin.alias("from"), F.col("span").alias("window"))
        .where(F.expr(f"(`from` - 1) div {span_tokens}") < F.col("window") - 1)
        .withColumn("slice", F.explode(F.array(F.expr(f"`from` div {size}") - 1, F.expr(f"`from` div {size}"))))
    )
    turns = summed.select("conv_id", "t", F.col("span").alias("own"), "end", begin.alias("begin"), F.expr(f"end div {size}").alias("at"))
    return turns.join(
        long_turns,
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("slice")) & (F.col("end") <= F.col("from"))
        & (F.col("begin") >= F.col("from") - history_tokens),
    ).select("conv_id", "t", "window", "own")


def format_chats(
    conversations: DataFrame, span_tokens: int = 1024, history_tokens: int = 256, system_role: str = "system",
    target_role: str = "assistant", block: int = 128,
) -> DataFrame:
    """Training windows of conversations.

    A window's own turns have at most ``span_tokens`` tokens together, beyond
    which the first of them may reach; its history has at most
    ``history_tokens``. No turn is cut or left out. Where the first turn of a
    conversation has the role ``system_role`` it is repeated at the head of
    each later window.

    Returns conv_id, window (long), n_context (long: the leading turns that are
    repeated), n_turns (long: all turns in the window), formatted (string) and
    loss_spans (array of start, end in code points, end exclusive), one row for
    each window; a target without text has an empty span. Turns are ordered by
    turn, nulls first, then role and text, so ties and repeated rows all stay,
    in a fixed order. A null text or role counts as empty. A null conv_id is a
    conversation of its own. An empty table gives an empty one; further columns
    are ignored.
    """
    require(conversations, "conv_id", "turn", "role", "text")
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", turn_tokens(F.col("text")))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    # Two levels of prefix sums: over the blocks of a conversation, then over the turns of a block.
    blocks = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("in_block"), F.count(F.lit(1)).alias("turns_in_block"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("turns_in_block").over(before), F.lit(0)).alias("rank_base"),
    )
    inside = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    summed = (
        turns.withColumn("here", F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("rank_here", F.row_number().over(inside))
        .join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
        .withColumn("end", F.col("base") + F.col("here"))
        .withColumn("first", (F.col("rank_base") + F.col("rank_here")) == 1)
        .withColumn("span", F.expr(f"(end - 1) div {span_tokens}"))
    )
    begin = F.col("end") - F.col("tokens")
    history = begin >= (F.col("span") + 1) * span_tokens - history_tokens
    body = F.struct(
        F.col("end").alias("order"), "role", escape_role(F.col("role")).alias("spelled"), escape(F.col("text")).alias("text")
    )
    system = summed.where(F.col("first") & (F.col("role") == system_role)).select(
        F.col("conv_id").alias("sc"), F.col("span").alias("s_span"), body.alias("system")
    )
    placed = summed.select(
        "conv_id", body.alias("t"),
        F.explode(F.when(history, F.array(F.col("span"), F.col("span") + 1)).otherwise(F.array("span"))).alias("window"),
        F.col("span").alias("own"),
    ).unionByName(before_long_turns(summed.withColumn("t", body), span_tokens, history_tokens))
    windows = placed.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.when(F.col("own") == F.col("window"), F.col("t")))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("own") != F.col("window"), F.col("t")))).alias("past"),
    )
    windows = windows.where(F.size("own") > 0).join(system, F.col("conv_id").eqNullSafe(F.col("sc")), "left")
    kept_system = (
        F.col("system").isNotNull() & (F.col("s_span") != F.col("window")) & ~F.exists("past", lambda t: t["order"] == F.col("system.order"))
    )
    context = F.concat(F.when(kept_system, F.array("system")).otherwise(F.slice("past", 1, 0)), F.col("past"))
    windows = windows.select("conv_id", "window", F.size(context).cast("long").alias("n_context"), F.concat(context, "own").alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), t["spelled"], F.lit(MIDDLE))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(CLOSE))), "")
    length = lambda t: F.char_length(t["spelled"]) + F.char_length(t["text"]) + len(OPEN) + len(MIDDLE) + len(CLOSE)
    span_type = "array<struct<start:int,end:int>>"
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("i"), F.array().cast(span_type).alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + length(t)).alias("at"),
            (acc["i"] + 1).alias("i"),
            F.when(
                (acc["i"] >= F.col("n_context")) & (t["role"] == target_role),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.char_length(head(t))).alias("start"),
                            (acc["at"] + F.char_length(head(t)) + F.char_length(t["text"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return windows.select(
        "conv_id", "window", "n_context", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"),
        walked.alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Read formatted windows back, from their text and spans alone.

    Returns conv_id, window, ``turns`` (array of role, text: the window's own
    turns, unescaped), ``loss_text`` (all text under the loss mask, unescaped)
    and ``formatted_chars``.
    """
    parts = F.split("formatted", F.lit(r"\Q" + CLOSE + r"\E"), -1)
    own = F.slice(parts, F.col("n_context").cast("int") + 1, F.size(parts) - 1 - F.col("n_context").cast("int"))

    def turn(part: Column) -> Column:
        cut = F.instr(part, MIDDLE)
        return F.struct(
            unescape(F.substring(part, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))).alias("role"),
            unescape(F.substring(part, cut + len(MIDDLE), F.char_length(part))).alias("text"),
        )

    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return windows.select(
        "conv_id", "window", F.transform(own, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
