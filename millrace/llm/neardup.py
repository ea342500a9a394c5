"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders the shingles of every document; a sketch keeps the ``k`` smallest hashes. The
retained values, put into inverted lists, generate overlapping sketches; the share of common values
among the ``k`` smallest of both sketches estimates the similarity and filters; full shingle sets
confirm every link. Linked documents form components.

Completeness. The sketch of a small set is the whole set, so two linked sets share at least
``ceil(threshold * n)`` of its ``n`` values. Of the ``k`` smallest hashes of a union with similarity J,
a binomial number with mean ``k * J`` lies in both sketches; ``SIGMAS`` standard deviations below the mean
is the least overlap that counts (odds of 2e-8 of missing a pair exactly at the threshold, and far
less above it). A pair that shares ``t`` of ``k`` values shares one of the ``k - t + 1`` values that are
rarest in the corpus, so only those are posted, and values of one document only are not posted at all.

Large groups. A cluster of near copies shares dozens of lists. So each document names its longest list, the named
lists are compared as a whole, and pairs that met there are left out elsewhere; a second round does the same
for what is still apart, and the few pairs that remain are joined one by one. A list is compared in
blocks of at most ``BLOCK`` members, whose overlaps are matrix products inside a task. What leaves a task is a
forest of links, never the pairs of a group.

Defined cases: NULL, empty and blank texts have the empty set and link with nothing. Rows with equal
sets are one class, copies are not compared. Rows that share a doc_id count as one document, and so do rows
without an id that have the same text; a component without any id is NULL. Ids stay below 2**62.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.bytes_ import shingle_hashes, words
from millrace.llm.components import components
from millrace.llm.store import Scratch, fresh

SKETCH_SIZE = 64
SIGMAS = 6.0
BLOCK = 512  # members of a list in one block; a list of m members is sent m / BLOCK times

_SKETCH_SCHEMA = "doc_id long, n_shingles long, set_hi long, set_lo long, sketch array<long>"


_NO_ID = 1 << 62


def least_overlap(size: int, percent: int) -> int:
    """The fewest of the ``size`` smallest values of a linked pair's union that lie in both sketches."""
    share = percent / 100
    return max(1, math.floor(size * share - SIGMAS * math.sqrt(size * share * (1 - share))))


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each row."""
    for chunk in words(column):
        n = np.diff(chunk.offsets)
        whole = shingle_hashes(chunk.hashes, shingle)
        for i in range(len(n)):
            a, b = chunk.offsets[i], chunk.offsets[i + 1]
            found = np.sort(whole[a : b - shingle + 1]) if b - a >= shingle else shingle_hashes(chunk.hashes[a:b], shingle)
            yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) > 1 else found


def sketches(docs: DataFrame, shingle: int = 4, size: int = SKETCH_SIZE) -> DataFrame:
    """``doc_id, n_shingles, set_hi, set_lo, sketch``: set size, 128-bit digest of the set, bottom-k sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, kept, ends = [], [], [], [0]
            for found in _sets(batch.column(1), shingle):
                n.append(len(found))
                digest.append(blake2b(found.tobytes(), digest_size=16).digest())
                kept.append(found[:size])
                ends.append(ends[-1] + len(kept[-1]))
            both = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
            values = np.concatenate([np.zeros(0, np.uint64), *kept]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), lists],
                names=["doc_id", "n_shingles", "set_hi", "set_lo", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(sketch, _SKETCH_SCHEMA)


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([x.tobytes() for x in _sets(batch.column(1), shingle)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["node", "whole"])

    return docs.mapInArrow(full, "node long, whole binary")


def _postings(classes: DataFrame, size: int, percent: int) -> DataFrame:
    """``v, node, n, df``: the rarest values of each sketch that a linked document may share."""
    values = classes.select("node", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    found = values.join(shared, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # Below this size a partner's sketch is its whole set as well, and the least overlap follows from the sizes.
    least = F.when(F.col("n") * 100 <= size * percent, F.ceil(F.col("n") * percent / 100)).otherwise(
        F.lit(least_overlap(size, percent))
    )
    held = F.least("n", F.lit(size))
    # Values of one document come first in the order of rarity, and match nothing.
    left = (held - least + 1) - (held - F.size("vs"))
    return (
        found.join(classes.select("node", "n"), "node")
        .withColumn("left", left.cast("int"))
        .filter("left > 0")
        .select("node", "n", F.explode(F.slice("vs", F.lit(1), F.col("left"))).alias("e"))
        .select("e.v", "node", "n", "e.df")
    )


class Comparison:
    """Compares full sets of shingle hashes by sketch and then exactly."""

    def __init__(self, size: int, percent: int):
        self.size, self.percent = size, percent

    def overlaps(self, sets: list[np.ndarray]) -> np.ndarray:
        """The number of common values of each pair of sets, by products of 0-1 matrices."""
        values = np.concatenate(sets)
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(values, kind="stable")
        values, rows = values[order], rows[order]
        begins = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
        column = np.cumsum(begins) - 1
        shared = np.bincount(column)[column] > 1
        rows, column = rows[shared], column[shared]
        out = np.zeros((len(sets), len(sets)), np.float32)
        if len(rows):
            column = np.cumsum(np.concatenate([[0], (column[1:] != column[:-1])]))
            for low in range(0, int(column[-1]) + 1, 4096):
                a, b = np.searchsorted(column, [low, low + 4096])
                part = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - low)), np.float32)
                part[rows[a:b], column[a:b] - low] = 1
                out += part @ part.T
        return out.astype(np.int64)

    def estimated(self, sets: list[np.ndarray]) -> np.ndarray:
        """Pairs that the sketch of their union does not rule out.

        Up to the smaller of their largest retained values both sketches are complete, which makes the
        values up to there a sketch of the union.
        """
        sketches_ = [x[: self.size] for x in sets]
        whole = np.array([len(x) <= self.size for x in sets])
        last = np.array([np.uint64(2**64 - 1) if w else x[-1] for x, w in zip(sketches_, whole, strict=True)], np.uint64)
        known = np.array([np.searchsorted(x, last, side="right") for x in sketches_])
        common = self.overlaps(sketches_)
        union, share = known + known.T - common, self.percent / 100
        loose = union * share - SIGMAS * np.sqrt(union * share * (1 - share))
        return np.where(whole[:, None] & whole[None, :], 100 * common >= self.percent * union, common >= loose)

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = np.sort(np.concatenate([x, y]))
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= self.percent * (len(both) - common)

    def links(self, sets: list[np.ndarray], wanted: np.ndarray) -> list[tuple[int, int]]:
        """A forest of links that connects whatever the wanted pairs connect."""
        n = np.array([len(x) for x in sets])
        wanted = wanted & (np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * self.percent)
        if not wanted.any():
            return []
        wanted &= self.estimated(sets)
        left, right = np.nonzero(np.triu(wanted | wanted.T, 1))
        if len(left) > 64:
            rows = np.unique(np.concatenate([left, right]))
            common = self.overlaps([sets[i] for i in rows])
            a, b = np.searchsorted(rows, left), np.searchsorted(rows, right)
            true = 100 * common[a, b] >= self.percent * (n[left] + n[right] - common[a, b])
            left, right = left[true], right[true]
            pairs = zip(left.tolist(), right.tolist(), strict=True)
        else:
            pairs = ((i, j) for i, j in zip(left.tolist(), right.tolist(), strict=True) if self.linked(sets[i], sets[j]))
        root, forest = list(range(len(sets))), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in pairs:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                forest.append((i, j))
        return forest


_LINKS = "a long, b long"


def _links_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])


def _compared(members: DataFrame, sets: DataFrame, test: Comparison) -> DataFrame:
    """Links between members (``v, node, comp, m``) of one list and different components."""
    count = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    placed = members.withColumn("own", own).join(sets, "node")
    dealt = placed.select(
        "v", "node", "comp", "own", "whole", F.explode(F.sequence(F.lit(0), count - 1)).alias("other")
    ).select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "whole")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def close() -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            comp = np.array([g[1] for g in group])
            wanted = comp[:, None] != comp
            if key[1] != key[2]:
                own = np.array([g[2] for g in group])
                wanted &= own[:, None] != own
            forest = test.links([g[3] for g in group], wanted)
            return [(group[i][0], group[j][0]) for i, j in forest]

        for batch in batches:
            found = []
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            for row, (v, i, j, own, node, comp) in enumerate(zip(*columns, strict=True)):
                if (v, i, j) != key:
                    found += close()
                    key, group = (v, i, j), []
                group.append((node, comp, own, np.frombuffer(batch.column(6)[row].as_buffer(), np.uint64)))
            yield _links_batch(found)
        yield _links_batch(close())

    by = ["v", "i", "j"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, _LINKS)


def _confirmed(pairs: DataFrame, sets: DataFrame, test: Comparison) -> DataFrame:
    """Pairs ``a, b`` that are linked: the union sketch filters, full sets decide."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                keep.append(bool(test.estimated([x, y])[0, 1]) and test.linked(x, y))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("whole").alias("wa")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("whole").alias("wb")), "b")
    return with_b.select("a", "b", "wa", "wb").mapInArrow(exact, _LINKS)


def _class_sets(docs: DataFrame, lists: DataFrame, shingle: int) -> DataFrame:
    """The full set of every posted class, from the text of the row that names it."""
    nodes = lists.select("node").distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    return _full_sets(texts.join(nodes.hint("shuffle_hash"), "node", "left_semi"), shingle)


def _sized(lists: DataFrame) -> DataFrame:
    """With ``m``, the members of each list; lists of one member go."""
    return lists.join(lists.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1"), "v")


def _named(lists: DataFrame) -> DataFrame:
    """The lists that are the longest one of some member."""
    return lists.groupBy("node").agg(F.max(F.struct("m", "v")).alias("top")).select("top.v").distinct()


def _component_links(lists: DataFrame, sets: DataFrame, test: Comparison, scratch: Scratch) -> DataFrame:
    """``node, component`` of all linked classes, from lists ``v, node, n``."""
    lists = scratch.write(_sized(lists), "sized")
    first = scratch.write(_named(lists), "named")
    links = _compared(lists.join(first, "v", "left_semi").withColumn("comp", F.col("node")), sets, test)
    labels = scratch.write(components(links, scratch), "labels")

    def apart(rest: DataFrame, met: DataFrame) -> DataFrame:
        """Members of lists that hold several components and were not met as a whole; ``met`` are lists gone through."""
        rest = rest.join(labels.withColumnRenamed("component", "comp"), "node", "left").join(met, "node", "left")
        rest = rest.withColumn("comp", F.coalesce("comp", "node")).withColumn("met", F.coalesce("met", F.array().cast("array<long>")))
        spread = rest.groupBy("v").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("comp", "met") for f in (F.min, F.max)))
        return rest.join(spread.filter("min_comp <> max_comp and (min_met <> max_met or size(min_met) = 0)").select("v"), "v", "left_semi")

    def gone_through(named: DataFrame) -> DataFrame:
        return lists.join(named, "v", "left_semi").groupBy("node").agg(F.sort_array(F.collect_set("v")).alias("met"))

    second = scratch.write(_sized(apart(lists.drop("m").join(first, "v", "left_anti"), gone_through(first))), "apart")
    named = scratch.write(_named(second), "named")
    more = scratch.write(_compared(second.join(named, "v", "left_semi"), sets, test), "links")
    both = first.union(named)
    left = scratch.write(apart(lists.drop("m").join(both, "v", "left_anti"), gone_through(both)), "apart")
    x = left.select("v", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "comp", "met")))
    y = left.select("v", *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "comp", "met")))
    new = (F.col("x_node") < F.col("y_node")) & (F.col("x_comp") != F.col("y_comp")) & ~F.arrays_overlap("x_met", "y_met")
    fit = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * test.percent
    pairs = x.join(y, (x.v == y.v) & new & fit).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    more = more.union(_confirmed(pairs, sets, test))
    for end in ("a", "b"):
        to = labels.select(F.col("node").alias(end), F.col("component").alias("to"))
        more = more.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    new = components(more, scratch)
    further = new.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = labels.join(further, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = scratch.write(moved.union(new.join(labels, "node", "left_anti")), "components")
    scratch.drop(lists, labels, second, left)
    return out


def _own_id() -> Column:
    """The doc_id, or without one a number beyond all ids that equal texts share."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(_NO_ID - 1) + F.lit(_NO_ID))


def _resolved(docs: DataFrame, shingle: int, percent: int, size: int) -> DataFrame:
    """``own, n_shingles, component`` for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(_own_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = ["set_hi", "set_lo", "n_shingles"]
    sketched = scratch.write(sketches(docs, shingle, size), "sketches")
    named = sketched.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
    classes = scratch.write(named.withColumnRenamed("n_shingles", "n"), "classes")
    rows = scratch.write(sketched.select("doc_id", *key), "rows")
    scratch.drop(sketched)
    lists = scratch.write(_postings(classes, size, percent), "lists")
    sets = scratch.write(_class_sets(docs, lists, shingle), "sets")
    linked = _component_links(lists, sets, Comparison(size, percent), scratch)
    scratch.drop(lists, sets)
    named = classes.withColumnRenamed("n", "n_shingles").select(*key, "node").join(linked, "node", "left")
    out = rows.join(named.select(*key, F.coalesce("component", "node").alias("component")), key, "left")
    return out.select(F.col("doc_id").alias("own"), "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, size: int = SKETCH_SIZE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id``, ``text``)."""
    known = lambda c: F.when(F.col(c) < _NO_ID, F.col(c))
    return _resolved(docs, shingle, percent, size).select(
        known("own").alias("doc_id"), "n_shingles", known("component").alias("component_id"), (F.col("own") == F.col("component")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, size: int = SKETCH_SIZE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id."""
    name = fresh(docs, "own")
    stay = _resolved(docs, shingle, percent, size).filter("own = component").select(F.col("own").alias(name)).distinct()
    return docs.withColumn(name, _own_id()).join(stay.hint("shuffle_hash"), name, "left_semi").select(docs.columns)
