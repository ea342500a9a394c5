"""Prefix trie of rebuilt conversations, by composable monoid fingerprints.

A conversation is rebuilt from the head of a base conversation and what follows its own head. No rebuilt text is ever made: each
turn is an affine map ``x -> a x + b`` modulo a prime, drawn from a digest of role and text, and a sequence of turns is the product of
its maps. The product of maps is associative, so a rebuilt prefix is the base's head product times the own suffix's product. Equal
prefixes have equal products.

* Products run along each conversation in segments of ``SEGMENT`` turns; products of segments are carried from one to the next.
* Rows ``(fingerprint, conversation, depth)`` are grouped to nodes. All turns of one digest are compared, as whole texts, with the
  stored turn that stands for it; a node's rows must agree in that reference and in the node above. By induction equal fingerprints then
  are equal sequences. If two ever differ, all is done again with other maps.
* A node's smallest member owns it. What a node counts is put at its owner's depth; sums from a member's end up to a depth, added
  over the members of a node, are the sums over its subtree, each node once, without walking the tree.

Scale. Every group is combined before its shuffle, or bounded: a conversation is split in segments, the ends of a node in pieces. Joins with
many rows on one side (the root's children, a common base) have a single row on the other, which adaptive execution can split. SHA-256
has to read a node's ends in order: they come as joined pieces of ``PIECE`` ids, and only these stream through one task.

Defined cases: rows without a conversation id are left out. A NULL role or text is empty. Turns with equal numbers are in the order of the
SHA-256 of their role, then of their text; equal rows are turns each. A NULL or negative head is 0; a NULL or absent base gives no turns. Other columns are not read. An empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.store import Scratch
from millrace.operators.ranking import with_position

PRIME = (1 << 61) - 1
SEGMENT = 512
PIECE = 4096
ATTEMPTS = 3
MAPS = ["pa", "pb", "qa", "qb", "sa", "sb", "ta", "tb"]  # prefix and the one before it, own suffix and the one before it


def _digests(turns: DataFrame, attempt: int) -> DataFrame:
    """128 bits for role and text."""
    return turns.withColumn("k1", F.xxhash64(F.lit(2 * attempt), "role", "text")).withColumn("k2", F.xxhash64(F.lit(2 * attempt + 1), "text", "role"))


def compose(xa: Column, xb: Column, ya: Column, yb: Column) -> tuple[Column, Column]:
    """The product of two affine maps, x first."""
    xa, xb, ya, yb = (c.cast("decimal(19,0)") for c in (xa, xb, ya, yb))
    prime = F.lit(PRIME).cast("decimal(19,0)")
    return ((xa * ya) % prime).cast("long"), (((xa * yb) % prime + xb) % prime).cast("long")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, segment, position, head, k1, k2, chars`` in order, to these and the products within each segment."""
    key, prefix, own = None, (1, 0), (1, 0)
    for batch in batches:
        convs, segments, positions, heads, k1, k2 = (batch.column(i).to_pylist() for i in range(6))
        out: list[list[int]] = [[] for _ in MAPS]
        for conv, segment, position, head, x, y in zip(convs, segments, positions, heads, k1, k2, strict=True):
            if (conv, segment) != key:
                key, prefix, own = (conv, segment), (1, 0), (1, 0)
            before, own_before = prefix, own
            a, b = x % (PRIME - 1) + 1, y % PRIME
            prefix = (before[0] * a % PRIME, (before[0] * b + before[1]) % PRIME)
            if position > head:
                own = (own_before[0] * a % PRIME, (own_before[0] * b + own_before[1]) % PRIME)
            for column, value in zip(out, (*prefix, *before, *own, *own_before), strict=True):
                column.append(value)
        columns = [batch.column(i) for i in range(7)] + [pa.array(c, pa.int64()) for c in out]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "segment", "position", "head", "k1", "k2", "chars", *MAPS])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products up to and with each row, for rows that already stand one segment later."""
    key, prefix, own = None, (1, 0), (1, 0)
    for batch in batches:
        out: list[list[int]] = [[] for _ in range(4)]
        for conv, a, b, c, d in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
            if conv != key:
                key, prefix, own = conv, (1, 0), (1, 0)
            prefix = (prefix[0] * a % PRIME, (prefix[0] * b + prefix[1]) % PRIME)
            own = (own[0] * c % PRIME, (own[0] * d + own[1]) % PRIME)
            for column, value in zip(out, (*prefix, *own), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in out)], names=["conv_id", "segment", "xpa", "xpb", "xsa", "xsb"]
        )


def _with_products(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Each turn with the products up to it and up to the one before, of all turns and of those after the own head."""
    segmented = turns.select("conv_id", F.expr(f"(position - 1) div {SEGMENT}").alias("segment"), "position", "head", "k1", "k2", "chars")
    by = ["conv_id", "segment"]
    longs = "conv_id long, segment long, position long, head long, k1 long, k2 long, chars long, " + ", ".join(f"{m} long" for m in MAPS)
    local = scratch.write(segmented.repartition(*by).sortWithinPartitions(*by, "position").mapInArrow(_products, longs), "products")
    ends = local.filter(F.col("position") % SEGMENT == 0).select(*by, "pa", "pb", "sa", "sb")
    # A segment that is not full is its conversation's last, and nothing comes after it.
    after = ends.select("conv_id", (F.col("segment") + 1).alias("segment"), "pa", "pb", "sa", "sb")
    in_order = after.repartition("conv_id").sortWithinPartitions(*by)
    carry = in_order.mapInArrow(_carried, "conv_id long, segment long, xpa long, xpb long, xsa long, xsb long")
    joined = local.join(carry, by, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("xpa", 1), ("xpb", 0), ("xsa", 1), ("xsb", 0))})
    made = {}
    for x, y in (("xp", "p"), ("xp", "q"), ("xs", "s"), ("xs", "t")):
        made[f"{y}a"], made[f"{y}b"] = compose(*(F.col(c) for c in (f"{x}a", f"{x}b", f"{y}a", f"{y}b")))
    return joined.withColumns(made).drop("xpa", "xpb", "xsa", "xsb", "segment")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``fa, fb, piece, ids`` in order to ``fa, fb, ends_sha256``: the pieces of a node, joined by commas, as they pass."""
    key, state, rows = None, None, []
    for batch in batches:
        for fa, fb, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (fa, fb) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                rows.append((*key, state.hexdigest()))
            key, state = (fa, fb), sha256(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["fa", "fb", "ends_sha256"])
            rows = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=["fa", "fb", "ends_sha256"])


def _ends_digest(ends: DataFrame) -> DataFrame:
    node = ["fa", "fb"]
    placed = with_position(ends.select(*node, "conv_id"), ["conv_id"], node)
    piece = F.expr(f"(position - 1) div {PIECE}").alias("piece")
    joined = placed.groupBy(*node, piece).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    in_order = joined.repartition(*node).sortWithinPartitions(*node, "piece")
    return in_order.mapInArrow(_hashed, "fa long, fb long, ends_sha256 string")


def _subtree_sums(members: DataFrame, values: DataFrame) -> DataFrame:
    """``fa, fb, depth`` with the sums over the subtree of what ``values`` has at each owner's depth."""
    segment = F.expr(f"depth div {SEGMENT}")
    rows = members.select("conv_id", "depth", "fa", "fb").join(values, ["conv_id", "depth"], "left").withColumn("segment", segment)
    names = ["leaf", "saved"]
    below = Window.partitionBy("conv_id", "segment").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(F.coalesce(n, F.lit(0))).over(below) for n in names})
    totals = values.groupBy("conv_id", segment.alias("segment")).agg(*(F.sum(n).alias(n) for n in names))
    # A segment without an own node has no row here; the next one that has carries what lies beyond.
    spans = members.filter(F.col("depth") % SEGMENT == 0).select("conv_id", segment.alias("segment"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = spans.join(totals, ["conv_id", "segment"], "left").select(
        "conv_id", "segment", *(F.coalesce(F.sum(n).over(later), F.lit(0)).alias(f"x_{n}") for n in names)
    )
    rows = rows.join(beyond, ["conv_id", "segment"])
    return rows.groupBy("fa", "fb", "depth").agg(*(F.sum(F.col(n) + F.col(f"x_{n}")).alias(n) for n in names))


def _unlike(turns: DataFrame) -> bool:
    """Whether turns of one digest differ in role or text from the turn that stands for them."""
    whole = F.struct("role", "text")
    pairs = turns.groupBy("k1", "k2").agg(F.min(whole).alias("least"), F.max(whole).alias("most"))
    return not pairs.filter("least <> most").isEmpty()


def prefix_trie(conversations: DataFrame, base: Column, head: Column) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, ref_conv_id, ref_position``.

    ``base`` and ``head`` are columns made of ``conv_id``: a conversation is rebuilt from the first ``head`` turns of ``base``, then
    its own turns after its first ``head``. A node is named by its smallest member; ``ref_conv_id`` and ``ref_position`` say
    which stored turn is its last.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    texts = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    for attempt in range(ATTEMPTS):
        digested = _digests(texts, attempt)
        if _unlike(digested):
            continue
        role, text = (F.unhex(F.sha2(c, 256)) for c in ("role", "text"))
        slim = digested.select("conv_id", "turn", role.alias("role_key"), text.alias("text_key"), F.length("text").cast("long").alias("chars"), "k1", "k2")
        placed = with_position(slim, ["turn", "role_key", "text_key"], ["conv_id"]).drop("turn", "role_key", "text_key")
        turns = scratch.write(placed.withColumn("head", F.greatest(F.coalesce(head.cast("long"), F.lit(0)), F.lit(0))), "turns")
        nodes = _trie(turns, base, scratch)
        if nodes is not None:
            return nodes
    raise RuntimeError(f"unequal turns or prefixes shared a fingerprint in {ATTEMPTS} attempts")


def _trie(turns: DataFrame, base: Column, scratch: Scratch) -> DataFrame | None:
    """The nodes, or None if unequal prefixes share a fingerprint."""
    products = scratch.write(_with_products(turns, scratch), "prefixes")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("head").alias("head")).withColumn("base", base.cast("long"))
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    convs = own.join(lengths, "base", "left").withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    convs = scratch.write(convs.select("conv_id", "base", "head", "taken", "length"), "conversations")

    turn = ["k1", "k2", "chars"]
    of_base = products.select(
        F.col("conv_id").alias("base"), F.col("position").alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb"), F.col("qa").alias("ga"), F.col("qb").alias("gb"), *turn
    )
    heads = convs.filter("taken > 0").join(of_base, "base").filter("depth <= taken").withColumn("ref_position", F.col("depth")).withColumn("ref_conv_id", F.col("base"))
    spliced = heads.filter("depth = taken").select("conv_id", F.col("fa").alias("xa"), F.col("fb").alias("xb"))
    spliced = convs.drop("head", "base").join(spliced, "conv_id", "left").withColumns({"xa": F.coalesce("xa", F.lit(1)), "xb": F.coalesce("xb", F.lit(0))})
    tail = products.filter("position > head").join(spliced, "conv_id")
    fa, fb = compose(F.col("xa"), F.col("xb"), F.col("sa"), F.col("sb"))
    ga, gb = compose(F.col("xa"), F.col("xb"), F.col("ta"), F.col("tb"))
    depth = F.col("taken") + F.col("position") - F.col("head")
    columns = ["fa", "fb", "ga", "gb", "depth", "conv_id", *turn, "ref_conv_id", "ref_position", "ends"]
    tail = tail.withColumns({"fa": fa, "fb": fb, "ga": ga, "gb": gb, "depth": depth, "ref_conv_id": F.col("conv_id"), "ref_position": F.col("position")})
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = {"fa": zero + 1, "fb": zero, "ga": none, "gb": none, "depth": zero, "k1": zero, "k2": zero, "chars": zero, "ref_conv_id": none, "ref_position": none}
    ends = {"ends": F.col("depth") == F.col("length")}
    members = convs.withColumns(root).withColumns(ends).select(columns)
    members = members.union(heads.withColumns(ends).select(columns)).union(tail.withColumns(ends).select(columns))
    members = scratch.write(members, "members")

    above = F.struct("ga", "gb")
    sides = [F.min(c) != F.max(c) for c in ("k1", "k2")] + [F.min(above) != F.max(above)]
    nodes = members.groupBy("fa", "fb", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("chars").alias("chars"),
        F.max("ga").alias("ga"),
        F.max("gb").alias("gb"),
        F.min(F.struct("ref_conv_id", "ref_position")).alias("ref"),
        (sides[0] | sides[1] | sides[2]).alias("unlike"),
    )
    nodes = scratch.write(nodes, "nodes")
    if not nodes.filter("unlike").isEmpty():
        return None
    key = ["fa", "fb", "depth"]
    children = nodes.filter("depth > 0").groupBy(F.col("ga").alias("fa"), F.col("gb").alias("fb"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = scratch.write(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    values = counted.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    )
    sums = _subtree_sums(members, values)
    parents = counted.select(F.col("fa").alias("ga"), F.col("fb").alias("gb"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    digests = _ends_digest(members.filter("ends"))
    found = counted.join(sums, key).join(digests, ["fa", "fb"], "left").join(parents, ["ga", "gb", "depth"], "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("ref.ref_conv_id").alias("ref_conv_id"),
        F.col("ref.ref_position").alias("ref_position"),
    )
