"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a share of the wanted number of words. The ratio of target to size, between 0 and
``MOST_COPIES``, is the expected number of copies of each of its documents. Its whole part is taken outright; the
fraction is a probability that pivotal rounding turns into 0 or 1: two documents meet, and mass moves at random from one to
the other until one of them is integral, so that the sum of the probabilities, and each document's own
probability, hold. Documents meet in descending size within a source, so that little changes in words.

Documents are dealt to small chunks by source, size class and a hash. A chunk leaves at most one
undecided document, and these residuals meet again on the next level, chunk by chunk, until a source has one left,
its smallest, which is drawn. A hot source has as many chunks as its rows need.

Defined cases: a NULL source is a source of its own, last in order. A NULL or empty text has size 0 and
takes 0 words; so do sources without words. Draws depend on doc_id, size and source only, so reruns agree; rows
equal in all three are interchangeable. Negative numbers do not occur.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.store import Scratch, fresh
from millrace.operators.ranking import with_position

CHUNK_ROWS = 4096
MOST_COPIES = 2
EPSILON = 1e-9


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target``: weights repeat over the sources by code point, NULL last.

    Targets share ``share`` times all sizes by weight; what exceeds ``most`` times a source's size is
    shared again by the others, until none is above.
    """
    order = with_position(sizes.withColumn("last", F.col("source").isNull()).withColumn("named", F.coalesce("source", F.lit(""))), ["last", "named"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("position") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    table = order.select("source", "source_size", weight.alias("weight"), cap.alias("cap"))
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("cap")
        total, held, free, now = table.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if now == stopped or not free:
            break
        level, stopped = (share * (total or 0) - (held or 0)) / free, now
    target = F.least(F.lit(level) * F.col("weight"), "cap")
    return table.select("source", "source_size", F.when(F.lit(not free), F.col("cap")).otherwise(target).alias("target"))


def _rounded(key: tuple, group: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Pivotal rounding of one chunk; ``extra`` is below zero for the undecided row, decided too if ``last``."""
    group = group.sort_values(["size", "lot", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
    p, draws = group["p"].to_numpy(), np.random.default_rng(int(group["seed"].iloc[0]) & (2**63 - 1)).random(len(group) + 1)
    out = np.zeros(len(p))
    open_, mass = -1, 0.0
    for i, q in enumerate(p):
        if q <= EPSILON or q >= 1 - EPSILON:
            out[i] = round(q)
            continue
        if open_ < 0:
            open_, mass = i, q
            continue
        both, stays, goes = mass + q, open_, i
        if both <= 1:
            # One of the two becomes 0, the other holds the mass of both.
            if draws[i] * both < q:
                stays, goes = i, open_
            out[goes], mass = 0.0, both
        else:
            # One of the two becomes 1, the other holds what is above.
            if draws[i] * (2 - both) < 1 - q:
                stays, goes = i, open_
            out[goes], mass = 1.0, both - 1
        open_ = stays
        if mass <= EPSILON or mass >= 1 - EPSILON:
            out[open_], open_ = round(mass), -1
    if open_ >= 0:
        out[open_] = float(draws[-1] < mass) if last else -1.0
        if not last:
            p = p.copy()
            p[open_] = mass
    return group.assign(p=p, extra=out)


_UNIT = "tag long, doc_id long, source string, size long, whole int, p double, lot long"
_NAMES = [column.split()[0] for column in _UNIT.split(", ")]


def _level(units: DataFrame, level: int, last: bool) -> DataFrame:
    """One level of the tree: units with ``extra``, below zero where undecided."""
    parts = F.xxhash64(F.lit(level), "doc_id", "size", "lot")
    bin_ = F.floor(F.log2(F.col("size") + 1) * 2).cast("int") if level == 0 else F.lit(0)
    units = units.withColumn("bin", bin_)
    counts = units.groupBy("source", "bin").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("chunks"))
    c = counts.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), "chunks")
    dealt = units.join(c, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    dealt = dealt.withColumn("slot", F.pmod(parts, "chunks")).withColumn("seed", F.xxhash64(F.lit(level), "source", "bin", "slot"))

    def round_(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _rounded(key, group, last)[[*_NAMES, "extra"]]

    return dealt.select(*_NAMES, "bin", "slot", "seed").groupBy("source", "bin", "slot").applyInPandas(round_, f"{_UNIT}, extra double")


def copies(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = MOST_COPIES) -> DataFrame:
    """``doc_id, lot, source, size, source_size, target, copies`` for each row of ``docs`` (``doc_id``, ``text``, ``source``).

    ``lot`` is a hash of id, source and text, the same for equal rows only.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("lot"),
    )
    rows = scratch.write(rows.withColumn("tag", F.monotonically_increasing_id()), "rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.write(source_targets(sizes, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("_s"), F.least(ratio, F.lit(float(most))).alias("ratio"))
    units = rows.join(t, F.col("source").eqNullSafe(F.col("_s"))).withColumn("whole", F.floor("ratio").cast("int"))
    units = units.withColumn("p", F.col("ratio") - F.col("whole"))
    decided, level, last = [], 0, False
    while True:
        done = scratch.write(_level(units.select(*_NAMES), level, last), f"level{level}")
        decided.append(done.filter("extra >= 0"))
        if last:
            break
        units = done.filter("extra < 0").drop("extra")
        level += 1
        # With no more residuals in any source than a chunk holds, the next level is the root.
        last = units.groupBy("source").count().filter(F.col("count") > CHUNK_ROWS).isEmpty()
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    out = out.join(t, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "lot", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    lot, times = fresh(docs, "lot"), fresh(docs, "times")
    taken = copies(docs, weights, share, most).groupBy("doc_id", "lot").agg(F.sum("copies").alias(times)).filter(F.col(times) > 0)
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("lot").alias("_lot"), times)
    rows = docs.withColumn(lot, F.xxhash64("doc_id", "source", "text"))
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    if not twice.isEmpty():
        # Copies of equal rows are counted together, so one of these rows stands for all.
        rows = rows.dropDuplicates(["doc_id", lot])
    same = rows["doc_id"].cast("long").eqNullSafe(taken["_id"]) & (rows[lot] == taken["_lot"])
    out = rows.join(taken.hint("shuffle_hash"), same)
    return out.select(*(rows[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(times)).select(docs.columns)
