"""Chat formatting for several speakers: each of them in turn is the assistant.

For every speaker of a conversation the whole dialogue is rendered once: that speaker's turns as the assistant, other
speakers' as users with their names, system turns as they are. Masks name the characters to learn from: what the assistant
says, and the mark that ends it.

A conversation of any length is rendered in parts of ``PART_TURNS`` turns; joined in their order, parts give the whole text, and the
spans of a part count from its beginning. Turns are numbered by range partitions, so that no task has to hold a long conversation.

Defined cases: turns go by ``turn``, NULL last, then by role and text, NULL first; equal rows are all rendered. A NULL role is the speaker
``unknown``, a NULL text an empty turn. Rows without a conv_id form one conversation. A conversation of system turns only has no
speaker and no row. ``<|`` inside of texts and names is written ``< |``, so that only the format makes marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.ranking import with_position

PART_TURNS = 64
SYSTEM = "system"
UNKNOWN = "unknown"
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _plain(text: Column, otherwise: str) -> Column:
    return F.replace(F.coalesce(text.cast("string"), F.lit(otherwise)), F.lit("<|"), F.lit("< |"))


def rotations(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, masks``; a mask is ``(start, end)`` in characters, end exclusive."""
    rows = turns.select("conv_id", F.col("turn"), _plain(F.col("role"), UNKNOWN).alias("name"), _plain(F.col("text"), "").alias("said"), "role", "text")
    rows = rows.withColumn("late", F.col("turn").isNull())
    placed = with_position(rows, ["late", "turn", "role", "text"], within=["conv_id"])
    placed = placed.withColumn("part", F.floor((F.col("position") - 1) / part_turns).cast("int"))
    parts = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("position", "name", "said"))).alias("turns"))
    speakers = rows.filter(F.col("name") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("name").alias("speaker")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))

    def head(turn: Column) -> Column:
        own = turn["name"] == F.col("speaker")
        who = F.when(own, F.lit("assistant")).when(turn["name"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), turn["name"]))
        return F.concat(F.lit(BEGIN), who, F.lit("\n"))

    pieces = F.transform(
        "turns",
        lambda t: F.struct(head(t).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"), (t["name"] == F.col("speaker")).alias("own")),
    )
    both = both.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.char_length(piece["head"])
        end = begin + F.char_length(piece["body"])
        spans = F.when(piece["own"], F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return both.select(
        "conv_id", "speaker", "part", F.size("turns").alias("n_turns"), text.alias("text"), F.aggregate("pieces", start, add)["spans"].alias("masks")
    )
