"""Chat formatting with Spark expressions only.

A conversation becomes one training string. Turns are collected as structs, sorted, adjacent turns of
one role share a block, and the pieces are concatenated. Control strings inside roles and texts are
escaped so that the string can be read back exactly. The loss mask marks assistant texts.

Defined cases: a null role or text is empty; a newline in a role is escaped; rows that tie on ``turn``
are ordered by role, then text; texts of any length stay whole; repeated rows stay; an empty table gives an empty table; other columns
are ignored. A row with a null conversation id belongs to the conversation null.
A conversation is one output row, so its turns meet in one task by definition of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT, NEWLINE = "<|im_start|>", "<|im_end|>", "<|im_next|>", "<|nl|>"


def escape(c: Column) -> Column:
    """Put one more backslash into every ``<\\*|``, so that no ``<|`` is left."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def _quoted(s: str) -> str:
    return s.replace("|", r"\|")


def format_chats(turns: DataFrame, loss_role: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, formatted, segments``: ``formatted`` is the segments' texts joined; a segment's ``loss`` is its mask."""
    none = F.lit("")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), none).alias("role"), F.coalesce(F.col(text), none).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    turns_ = F.col("turns")

    def pieces(t: Column, i: Column) -> Column:
        before = F.get(turns_, i - 1)["role"]
        same = (i > 0) & (before == t["role"])
        head = F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(none), F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        lead = F.when(same, F.lit(NEXT)).otherwise(head)
        return F.array(F.struct(lead.alias("text"), F.lit(False).alias("loss")), F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))

    last = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
    segments = sorted_turns.select("conv_id", F.concat(F.flatten(F.transform(turns_, pieces)), last).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    body = F.substring(formatted, F.lit(len(START) + 1), F.char_length(formatted) - len(START + END + "\n"))
    blocks = F.split(body, _quoted(END) + "\n" + _quoted(START))

    def turns(block: Column) -> Column:
        role = unescape(F.replace(F.substring_index(block, "\n", 1), F.lit(NEWLINE), F.lit("\n")))
        texts = F.split(F.substring(block, F.instr(block, F.lit("\n")) + 1, F.char_length(block)), _quoted(NEXT))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted conversation says, read back from it."""
    c = chats.select("conv_id", "formatted", "segments", read_back(F.col("formatted")).alias("turns"))
    c = c.withColumn("loss_text", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
