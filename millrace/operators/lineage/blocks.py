"""Graph rounds by blocks: each task settles its own part of the graph, and only what crosses to other parts is exchanged.

Nodes are numbered in the order of their ids, so that strings become whole numbers once, and neighbours in that order share a block.
A block holds about as many edges as a task should take. In a round, a block takes in what others sent, works on until nothing
more changes inside, and sends on what concerns nodes elsewhere, combined per node. So rounds follow the number of times
a path changes blocks, not its length, and a round opens only the blocks that were written to.

A node with very many edges hands them to relays, each with a share, which pass on what they get: no block grows with a hub.
"""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lineage.rounds import check_round
from millrace.operators.scan import scan
from millrace.operators.skew import add_salt, hot_keys, repeat_for_salts
from millrace.session import scratch_dir, stored

# What runs in Python workers travels with the job.
cloudpickle.register_pickle_by_value(sys.modules["millrace"])

#: A task works on so many edges in about the time that a round costs in any case; the number of blocks follows from the table.
EDGES_PER_BLOCK = 500_000
HUB_EDGES = EDGES_PER_BLOCK // 8
MOST_BUCKETS = 10_000
NODE, SENDER, RECEIVER = 0, 1, 2  # a node, a relay of a hub's outgoing edges, and one of its incoming edges


@dataclass
class Part:
    """The edges of a block's nodes: those of node ``first + i`` are ``out_ptr[i]`` to ``out_ptr[i + 1]``."""

    block: int
    first: int
    out_ptr: np.ndarray
    out_to: np.ndarray
    out_step: np.ndarray  # 0 where a relay is concerned, which is no step on a path
    in_ptr: np.ndarray
    in_from: np.ndarray

    @property
    def size(self) -> int:
        return len(self.out_ptr) - 1


def edges_of(ptr: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all edges of ``nodes``, and for each the node it belongs to."""
    count = ptr[nodes + 1] - ptr[nodes]
    at = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + np.repeat(ptr[nodes], count)
    return at, np.repeat(nodes, count)


def _node(column: str):
    return F.struct(F.lit(NODE).alias("kind"), F.col(column).alias("id"), F.lit(0).alias("salt"))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def one_by_one(spark: SparkSession):
    """Rows go to Python workers one at a time: each is a block, and a task may get as many as its files hold."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "1")
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


State = dict[str, np.ndarray]
# part, state before, messages received -> state, number that is observed, messages (node, columns...) to anywhere
Step = Callable[[Part, State | None, list[np.ndarray]], tuple[State, int, np.ndarray]]


class BlockGraph:
    """Edges in blocks, stored once; ``run`` works on them in rounds."""

    def __init__(self, edges: DataFrame, edges_per_block: int = EDGES_PER_BLOCK, hub_edges: int = HUB_EDGES):
        """``edges(source_id, target_id)``, each once."""
        self.spark = edges.sparkSession
        self.root = scratch_dir(self.spark, "blocks")
        self.name = f"millrace_blocks_{uuid.uuid4().hex[:12]}"
        self._latest: dict[int, int] = {}
        self._rounds = 0
        self.rounds = 0
        edges = stored(edges.select("source_id", "target_id"))
        plain = edges.select(_node("source_id").alias("s"), _node("target_id").alias("t"), F.lit(1).cast("byte").alias("step"))
        # Most graphs have no hubs; where there are some, numbers are given again, to the relays as well.
        if self._number(plain, edges_per_block) > hub_edges:
            plain = self._relayed(edges, hub_edges)
            self._number(plain, edges_per_block)
        self._store(plain)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _relayed(self, edges: DataFrame, limit: int) -> DataFrame:
        """Edges between nodes and relays, which stand between a hub and its neighbours."""
        out_hubs, in_hubs = hot_keys(edges, ["source_id"], limit), hot_keys(edges, ["target_id"], limit)

        def ends(salted: DataFrame, hubs: DataFrame | None, end: str, kind: int, name: str) -> DataFrame:
            if hubs is None:
                return salted.withColumn(name, _node(end)).drop("salt")
            hub = hubs.select(end, F.lit(True).alias("hub"))
            known = salted.join(hub, end, "left")
            relay = F.when(F.col("hub"), kind).otherwise(NODE)
            return known.withColumn(name, F.struct(relay.alias("kind"), F.col(end).alias("id"), F.col("salt").alias("salt"))).drop("salt", "hub")

        placed = ends(add_salt(edges, ["source_id"], ["target_id"], out_hubs), out_hubs, "source_id", SENDER, "s")
        placed = ends(add_salt(placed, ["target_id"], ["source_id"], in_hubs), in_hubs, "target_id", RECEIVER, "t")
        rows = placed.select("s", "t", F.lit(1).cast("byte").alias("step"))
        for hubs, end, kind in ((out_hubs, "source_id", SENDER), (in_hubs, "target_id", RECEIVER)):
            if hubs is None:
                continue
            each = repeat_for_salts(hubs.select(end), [end], hubs)
            hub = _node(end)
            relay = F.struct(F.lit(kind).alias("kind"), F.col(end).alias("id"), F.col("salt").alias("salt"))
            s, t = (hub, relay) if kind == SENDER else (relay, hub)
            rows = rows.union(each.select(s.alias("s"), t.alias("t"), F.lit(0).cast("byte").alias("step")))
        return stored(rows)

    def _number(self, edges: DataFrame, edges_per_block: int) -> int:
        """Make ``nodes(kind, id, salt, num, block)``, numbers from 0 in the order of kind and id. Returns the largest number of edges on one side of a node."""
        ends = F.array(F.struct("s.*", F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct("t.*", F.lit(0).alias("out"), F.lit(1).alias("into")))
        degree = edges.select(F.inline(ends)).groupBy("kind", "id", "salt").agg(F.sum("out").alias("n_out"), F.sum("into").alias("n_in"))
        degree = degree.withColumn("n_edges", F.col("n_out") + F.col("n_in"))
        counted = scan(degree, ["kind", "id", "salt"], number="position", sums={"upto": "n_edges"})
        most = counted.agg(F.coalesce(F.max(F.greatest("n_out", "n_in")), F.lit(0))).first()[0]
        block = F.expr(f"(upto - n_edges) div {2 * edges_per_block}").cast("int").alias("block")
        self.nodes = counted.select("kind", "id", "salt", (F.col("position") - 1).alias("num"), block)
        # One row a block: they grow with the edges over a million.
        bounds = self.nodes.groupBy("block").agg(F.min("num").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()
        self.blocks = [r.block for r in bounds]
        self.firsts = np.array([r.first for r in bounds] + [bounds[-1]["first"] + bounds[-1]["n"]] if bounds else [0], np.int64)
        self.buckets = max(1, min(len(self.blocks), MOST_BUCKETS))
        return most

    def _store(self, edges: DataFrame) -> None:
        num = self.nodes.select(F.struct("kind", "id", "salt").alias("n"), "num", "block")
        source = num.select(F.col("n").alias("s"), F.col("num").alias("s_num"), F.col("block").alias("s_block"))
        target = num.select(F.col("n").alias("t"), F.col("num").alias("t_num"), F.col("block").alias("t_block"))
        known = edges.join(source, "s").join(target, "t")
        sides = F.array(
            F.struct(F.col("s_block").alias("block"), F.lit(0).alias("side"), F.col("s_num").alias("own"), F.col("t_num").alias("other"), "step"),
            F.struct(F.col("t_block").alias("block"), F.lit(1).alias("side"), F.col("t_num").alias("own"), F.col("s_num").alias("other"), "step"),
        )
        both = known.select(F.inline(sides)).repartition(self.buckets, "block").sortWithinPartitions("block", "side", "own")
        firsts = dict(zip(self.blocks, zip(self.firsts.tolist(), np.diff(self.firsts).tolist())))
        shared = self.spark.sparkContext.broadcast(firsts)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []

            def made() -> pa.RecordBatch:
                side, own, other, step = (np.concatenate(c) for c in zip(*held, strict=True))
                first, size = shared.value[key]
                cut = int(np.searchsorted(side, 1))
                lists = []
                for low, high in ((0, cut), (cut, len(side))):
                    lists += [np.searchsorted(own[low:high], np.arange(first, first + size + 1)).astype(np.int32), other[low:high].astype(np.int64)]
                part = Part(key, first, lists[0], lists[1], step[:cut].astype(np.int8), lists[2], lists[3])
                return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([pickle.dumps(part.__dict__)])], names=["block", "part"])

            for batch in batches:
                columns = [batch.column(i).to_numpy() for i in range(5)]
                change = np.flatnonzero(np.diff(columns[0])) + 1
                for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                    if low == high:
                        continue
                    if columns[0][low] != key:
                        if held:
                            yield made()
                        key, held = int(columns[0][low]), []
                    held.append([c[low:high].copy() for c in columns[1:]])
            if held:
                yield made()

        rows = both.mapInArrow(packed, "block int, part binary")
        rows.write.bucketBy(self.buckets, "block").option("path", f"{self.root}/parts").format("parquet").saveAsTable(self.name)

    def _round(self, number: int, kind: str) -> DataFrame:
        return self.spark.read.schema("block int, to int, payload binary, number long").parquet(f"{self.root}/rounds/{number}/kind={kind}")

    def _states(self, blocks: list[int] | None = None) -> DataFrame:
        """The last state of each of ``blocks``, from the round that wrote it."""
        at: dict[int, list[int]] = {}
        for block in self.blocks if blocks is None else blocks:
            at.setdefault(self._latest[block], []).append(block)
        found = [self._round(number, "state").filter(F.col("block").isin(some)) for number, some in at.items()]
        return reduce(DataFrame.union, found).select("block", F.col("payload").alias("state"))

    def _with_states(self, blocks: list[int] | None = None) -> DataFrame:
        """Blocks with their last states. Neither is broadcast: a file says little of how large they get, and all would meet in the driver, in each round."""
        parts = self.spark.table(self.name)
        if blocks is not None and len(blocks) < len(self.blocks):
            parts = parts.filter(F.col("block").isin(blocks))
        if not self._latest:
            return parts.withColumn("state", F.lit(None).cast("binary"))
        return parts.hint("merge").join(self._states(blocks).hint("merge"), "block", "left")

    def _with_inbox(self, rows: DataFrame, round_no: int | None) -> DataFrame:
        """The messages that round ``round_no`` sent to the blocks."""
        if round_no is None:
            return rows.withColumn("inbox", F.lit(None).cast("array<binary>"))
        inbox = self._round(round_no, "message").groupBy(F.col("to").alias("block")).agg(F.collect_list("payload").alias("inbox"))
        return rows.hint("merge").join(inbox.hint("merge"), "block", "left")

    def run(self, step: Step, max_rounds: int | None = None) -> int:
        """Rounds of ``step`` until no block has anything to send. The first is over all blocks and without messages.

        Returns the sum of the observed numbers of the first round's blocks, each with its last one.
        """
        observed: dict[int, int] = {}
        touched, round_no = list(self.blocks), self._rounds
        firsts, first_round = self.spark.sparkContext.broadcast(self.firsts), True
        blocks = self.spark.sparkContext.broadcast(np.array(self.blocks, np.int64))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds, names = firsts.value, blocks.value
            for batch in batches:
                for row in range(batch.num_rows):
                    part = Part(**pickle.loads(batch.column("part")[row].as_py()))
                    state, inbox = batch.column("state")[row].as_py(), batch.column("inbox")[row].as_py()
                    got = [pickle.loads(m) for m in inbox or []]
                    new, number, out = step(part, None if state is None else pickle.loads(state), got)
                    kinds, targets, payloads = ["state"], [part.block], [pickle.dumps(new)]
                    where = np.searchsorted(bounds, out[:, 0], side="right") - 1
                    for place in np.unique(where).tolist():
                        kinds.append("message")
                        targets.append(int(names[place]))
                        payloads.append(pickle.dumps(out[where == place]))
                    n = len(kinds)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.block] * n, pa.int32()), pa.array(targets, pa.int32()), pa.array(payloads, pa.binary()), pa.array([number] * n), pa.array(kinds)],
                        names=["block", "to", "payload", "number", "kind"],
                    )

        while touched:
            check_round(round_no - self._rounds, max_rounds)
            rows = self._with_inbox(self._with_states(touched), None if first_round else round_no - 1)
            found = rows.select("block", "part", "state", "inbox").mapInArrow(work, "block int, to int, payload binary, number long, kind string")
            seen = Observation()
            # Blocks and their numbers, and the blocks that were written to: as many as there are blocks at most.
            ended = F.collect_set(F.when(F.col("kind") == "state", F.struct("block", "number"))).alias("ended")
            sent_to = F.collect_set(F.when(F.col("kind") == "message", F.col("to"))).alias("sent_to")
            with one_by_one(self.spark):
                found.observe(seen, ended, sent_to).write.partitionBy("kind").parquet(f"{self.root}/rounds/{round_no}")
            for row in seen.get["ended"] or []:
                self._latest[row["block"]] = round_no
                observed[row["block"]] = row["number"]
            touched = sorted(seen.get["sent_to"] or [])
            round_no, first_round = round_no + 1, False
            self.rounds += 1
        self._rounds = round_no
        return sum(observed.values())

    def values(self, pick: Callable[[Part, State], list[np.ndarray]], schema: str) -> DataFrame:
        """Rows ``num, ...`` that ``pick`` makes of the last state of every block."""
        rows = self._with_states().select("part", "state")
        names = [c.split()[0] for c in schema.split(", ")]

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    part = Part(**pickle.loads(batch.column(0)[row].as_py()))
                    columns = pick(part, pickle.loads(batch.column(1)[row].as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        with one_by_one(self.spark):
            return stored(rows.mapInArrow(picked, schema))
