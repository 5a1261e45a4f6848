"""Chat formatting with Spark expressions only: sorted turn structs, merged same-role turns, one string.

A block is ``<|start|>role``, a line break, the texts of adjacent turns of that
role with ``<|and|>`` between them, ``<|end|>`` and a line break. Inside roles and
texts every ``<`` is followed by ``~`` and every ``[`` too, so no control string of
this or the usual bracket templates can occur there, and taking the mark out
again gives the text back. A line break in a role is written ``<n``.

``segments`` is the string cut where the loss mask changes: assistant texts
carry loss, everything else doesn't. The string is the segments put together.

Defined results
* Turns are sorted by turn, then role and text (nulls first); rows that repeat are formatted as often as they occur.
* A null role or text is empty. Rows with a null conv_id are one conversation.
* An empty table has no conversations. Other columns are not read.
* A conversation is one row, so it has to fit into a string (2 GB) as its formatted text does anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START, AND, END = "<|start|>", "<|and|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<~")), F.lit("["), F.lit("[~"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[~"), F.lit("[")), F.lit("<~"), F.lit("<"))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>) for each conversation; one shuffle of the texts."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("bigint").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def parts(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        closes = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        role = F.replace(escaped(t["role"]), F.lit("\n"), F.lit("<n"))
        before = F.when(opens, F.concat(F.lit(START), role, F.lit("\n"))).otherwise(AND)
        after = F.when(closes, F.lit(END)).otherwise("")
        return F.array(
            F.struct(before.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
            F.struct(after.alias("text"), F.lit(False).alias("loss")),
        )

    cut = sorted_turns.select("conv_id", F.flatten(F.transform("turns", parts)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text) from ``formatted`` and ``segments`` alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        line = F.locate("\n", block)
        role = unescaped(F.replace(F.substring(block, F.lit(len(START) + 1), line - len(START) - 1), F.lit("<n"), F.lit("\n")))
        texts = F.split(F.substring(block, line + 1, F.length(block)), r"<\|and\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return chats.select("conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def digests(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what is read back."""
    back = read_back(chats)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
