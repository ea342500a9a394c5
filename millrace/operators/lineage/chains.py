"""Paths without branches, contracted to single edges by pointer jumping.

A node with one edge in and one edge out only hands a walk on. Each such inner node gets a pointer to the next one, and in every
round all pointers jump to where the pointer they point to leads. After ``k`` rounds they span ``2**k`` nodes, so a path of any
length is known after the logarithm of its length. A walk then crosses it in one step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage.rounds import RoundTable
from millrace.session import shuffle_partitions, stored


@dataclass
class Contracted:
    """``edges(from_id, to_id, length)`` without inner nodes, and where each inner node lies: ``inner(id, entry, length)``.

    An inner node is ``length`` steps behind its ``entry``, a node that was kept. ``rounds`` is the number of jumps.
    """

    edges: DataFrame
    inner: DataFrame
    rounds: int


def contract(edges: DataFrame, keep: DataFrame) -> Contracted | None:
    """``edges(from_id, to_id)`` with its unbranched paths contracted, or None where no two inner nodes are neighbours.

    Nodes of ``keep(id)`` are never inner. Circles of inner nodes alone cannot be entered from any other node, and are left out.
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("next"), F.lit(None).cast(edges.schema["from_id"].dataType).alias("prev")),
            F.struct(F.col("to_id").alias("id"), F.lit(None).cast(edges.schema["to_id"].dataType).alias("next"), F.col("from_id").alias("prev")),
        )
    )
    degrees = edges.select(ends.alias("e")).select("e.*").groupBy("id").agg(
        F.count("next").alias("n_out"), F.count("prev").alias("n_in"), F.max("next").alias("next"), F.max("prev").alias("prev")
    )
    passing = degrees.filter("n_out = 1 AND n_in = 1 AND next <> id").select("id", "next", "prev")
    inner = stored(passing.join(keep.select("id"), "id", "left_anti"))
    ids = inner.select(F.col("id").alias("next"), F.lit(True).alias("goes_on"))
    start = stored(inner.join(ids, "next", "left").select("id", "next", "prev", F.coalesce("goes_on", F.lit(False)).alias("goes_on")))
    if start.filter("goes_on").isEmpty():
        return None
    last, rounds = _ends(start)
    # The first of a path is the one whose predecessor is kept.
    first = start.join(inner.select(F.col("id").alias("prev")), "prev", "left_anti").select("id", F.col("prev").alias("entry"))
    tails = start.filter("NOT goes_on").select(F.col("id").alias("last"), F.col("next").alias("leaves_to"))
    paths = stored(
        first.join(last, "id").join(tails, "last").select("last", "entry", "leaves_to", F.col("length").alias("span"))
    )
    kept = edges.select("from_id", "to_id", F.lit(1).cast("long").alias("length"))
    kept = kept.join(inner.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    kept = kept.join(inner.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id", "length")
    across = paths.select(F.col("entry").alias("from_id"), F.col("leaves_to").alias("to_id"), (F.col("span") + 2).alias("length"))
    placed = last.join(paths.select("last", "entry", "span"), "last")
    placed = placed.select("id", "entry", (F.col("span") - F.col("length") + 1).alias("length"))
    return Contracted(kept.union(across), placed, rounds)


def _ends(start: DataFrame) -> tuple[DataFrame, int]:
    """``(id, last, length)``: the last inner node of each one's path and the steps to it; also the number of rounds."""
    spark = start.sparkSession
    zero = F.lit(0).cast("long")
    with RoundTable(spark, "pointers", ("done",)) as pointers:
        at = F.when(F.col("goes_on"), F.col("next")).otherwise(F.col("id")).alias("at")
        rows = start.select("id", at, F.when(F.col("goes_on"), zero + 1).otherwise(zero).alias("length"), (~F.col("goes_on")).alias("done"))
        left = pointers.append(rows, 0, {"left": F.count_if(~F.col("done"))})["left"]
        round_no, before = 0, None
        # A round in which no pointer arrives leaves only circles.
        while left and left != before:
            going = pointers.at(round_no).filter("NOT done").select("id", "at", "length")
            known = pointers.all().filter(F.col("done") | (F.col("round") == round_no))
            known = known.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("length").alias("more"), "done")
            jumped = going.join(known, "at").select("id", F.col("further").alias("at"), (F.col("length") + F.col("more")).alias("length"), "done")
            round_no, before = round_no + 1, left
            left = pointers.append(jumped.repartition(shuffle_partitions(spark), "id"), round_no, {"left": F.count_if(~F.col("done"))})["left"]
        return pointers.result().filter("done").select("id", F.col("at").alias("last"), "length"), round_no
