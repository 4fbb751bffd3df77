"""Chat formatting in Spark expressions only: sort, merge, escape, mark, and read back.

A conversation becomes one string of messages::

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT...<|end|>\\n

Adjacent turns of one role are one message, their texts parted by ``<|next|>``. In roles and
texts a backslash is doubled and ``<|`` is written ``<\\|``, so that no text can hold a mark and
:func:`read_turns` gives back exactly what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
#: Turns whose numbers fall into one block are collected together, then the blocks of a conversation.
BLOCK_TURNS = 256


def escape(s: Column) -> Column:
    """A text that holds no mark; null stays null, an empty one is empty."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(s: Column) -> Column:
    """What was escaped, exactly; null stays null."""
    return F.replace(F.replace(s, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _glue(parts: Column, opened: bool) -> Column:
    """Joins sorted parts (first, last, body): a mark before each, by the role of the one before.

    opened: the first part gets its own opening mark.
    """

    def mark(x: Column, i: Column) -> Column:
        opening = F.concat(F.lit(TURN), x["first"], F.lit(TEXT))
        before = F.get(parts, i - 1)["last"]
        return F.concat(
            F.when(i == 0, opening if opened else F.lit(""))
            .when(before == x["first"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END), opening)),
            x["body"],
        )

    return F.array_join(F.transform(parts, mark), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are sorted by turn,
    then role, then text; a null turn comes first, a null role or text counts as empty, repeated
    rows are repeated turns, and the rows with a null conv_id are one conversation. An empty
    table gives no row.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
        F.struct(
            "turn",
            escape(F.coalesce("role", F.lit(""))).alias("role"),
            escape(F.coalesce("text", F.lit(""))).alias("text"),
        ).alias("t"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = F.transform("ts", lambda t: F.struct(t["role"].alias("first"), t["role"].alias("last"), t["text"].alias("body")))
    glued = blocks.withColumn("parts", parts).select(
        "conv_id",
        F.struct(
            "block",
            F.get("parts", F.lit(0))["first"].alias("first"),
            F.element_at("parts", -1)["last"].alias("last"),
            _glue(F.col("parts"), opened=False).alias("body"),
        ).alias("b"),
    )
    whole = glued.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    return whole.select("conv_id", F.concat(_glue(F.col("bs"), opened=True), F.lit(END)).alias("formatted"))


def pieces(formatted: Column) -> Column:
    """array<struct<s, role, loss>>: the string cut at its marks; loss only on assistant texts.

    role is set on texts, null on marks; the pieces joined are the string again.
    """
    def piece(s: Column, role: Column, loss: Column) -> Column:
        return F.struct(s.alias("s"), role.alias("role"), loss.alias("loss"))

    none, no = F.lit(None).cast("string"), F.lit(False)
    # the last item of the split is the empty string behind the last mark
    messages = F.split(formatted, r"<\|end\|>\n")
    messages = F.slice(messages, 1, F.size(messages) - 1)

    def message(m: Column) -> Column:
        role = F.substring_index(F.substring(m, F.lit(len(TURN) + 1), F.length(m)), TEXT, 1)
        head = F.concat(F.lit(TURN), role, F.lit(TEXT))
        texts = F.split(F.substring(m, F.length(head) + 1, F.length(m)), r"<\|next\|>")
        cut = F.transform(
            texts,
            lambda t, i: F.array(
                piece(F.when(i == 0, head).otherwise(F.lit(NEXT)), none, no),
                piece(t, role, role == F.lit("assistant")),
            ),
        )
        return F.concat(F.flatten(cut), F.array(piece(F.lit(END), none, no)))

    return F.flatten(F.transform(messages, message))


def loss_runs(formatted: Column) -> Column:
    """array<struct<chars, loss>>: the loss mask over the code points, as runs in order."""
    return F.transform(pieces(formatted), lambda p: F.struct(F.length(p["s"]).alias("chars"), p["loss"].alias("loss")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back, unescaped."""
    texts = F.filter(pieces(formatted), lambda p: p["role"].isNotNull())
    return F.transform(texts, lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(p["s"]).alias("text")))


def loss_text(formatted: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    under = F.filter(pieces(formatted), lambda p: p["loss"])
    return F.array_join(F.transform(under, lambda p: unescape(p["s"])), "")
