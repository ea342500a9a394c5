"""Topological levels and order, and cyclic components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage.blocks import NODE, BlockGraph, Part, State, edges_of
from millrace.operators.ranking import with_position
from millrace.session import stored


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The given nodes and those that only edges name."""
    return nodes.select("id").union(endpoints(edges)).distinct()


def reachable_levels(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(id, level)``: the longest path from a node without inputs, 0 for such a node itself.

    A node gets its level when the last of its inputs has one, so each edge is used once. Nodes on
    a cycle, and nodes behind one, get none and are missing from the result.
    """
    return _levels(nodes, edges, max_rounds)[0]


def _levels(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, int]:
    """Levels of the given nodes and of those that only edges name, and how many nodes have none."""
    # An edge from a node to itself stays: such a node never has all its inputs.
    with BlockGraph(edges.select("source_id", "target_id").distinct()) as graph:
        none, nodes = F.lit(0).cast("bigint").alias("level"), nodes.select("id").distinct()
        if not graph.blocks:
            return nodes.select("id", none), 0
        waiting = graph.run(_level_step, max_rounds)
        found = graph.values(_known_levels, "num long, level long")
        placed = graph.nodes.filter(F.col("kind") == NODE).select("id", "num")
        levels = found.join(placed, "num").select("id", "level")
        return stored(levels.union(nodes.join(placed.select("id"), "id", "left_anti").select("id", none))), waiting


def _level_step(part: Part, state: State | None, inbox: list[np.ndarray]) -> tuple[State, int, np.ndarray]:
    """Count off inputs that have a level. A node whose last input arrives gets its level and passes it on, at once within the block.

    Messages are ``node, inputs counted off, level from them``.
    """
    if state is None:
        state = {"need": np.diff(part.in_ptr).astype(np.int64), "level": np.zeros(part.size, np.int64)}
        ready = np.flatnonzero(state["need"] == 0)
    else:
        ready = np.zeros(0, np.int64)
    need, level = state["need"], state["level"]
    for message in inbox:
        node = message[:, 0] - part.first
        need[node] -= message[:, 1]
        level[node] = np.maximum(level[node], message[:, 2])
        ready = np.append(ready, node[need[node] == 0])
    away = []
    while len(ready):
        at, source = edges_of(part.out_ptr, ready)
        target, reached = part.out_to[at], level[source] + part.out_step[at]
        node = target - part.first
        here = (node >= 0) & (node < part.size)
        away.append(np.stack([target[~here], np.ones((~here).sum(), np.int64), reached[~here]], axis=1))
        node = node[here]
        np.subtract.at(need, node, 1)
        np.maximum.at(level, node, reached[here])
        ready = np.unique(node[need[node] == 0])
    return state, int((need > 0).sum()), _combined(away, (np.add, np.maximum))


def _combined(messages: list[np.ndarray], how: tuple[np.ufunc, ...]) -> np.ndarray:
    """One message for each node: further columns are combined as ``how`` says."""
    if not messages:
        return np.zeros((0, 1 + len(how)), np.int64)
    rows = np.concatenate(messages)
    if not len(rows):
        return rows
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    first = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1))
    return np.stack([rows[first, 0], *(f.reduceat(rows[:, i], first) for i, f in enumerate(how, 1))], axis=1)


def _known_levels(part: Part, state: State) -> list[np.ndarray]:
    known = np.flatnonzero(state["need"] == 0)
    return [known + part.first, state["level"][known]]


def cyclic_components(edges: DataFrame, **sizes: int) -> DataFrame:
    """``(id, component)`` for every node on a cycle; the component is named by its smallest id.

    Acyclic parts are trimmed first, from both sides. What is left is split by two labels: the
    smallest id that reaches a node, and the smallest id that it reaches. Where they are equal, the
    node is on a cycle with that id, and all such nodes form its component. An edge whose ends
    differ in a label lies on no cycle; the other edges go round again without the found nodes. A
    node with an edge to itself is a component too. Trimming and labels run to their end within a block; blocks exchange
    what their boundary nodes have. No pairs of nodes are formed.
    """
    pairs = edges.select("source_id", "target_id").distinct()
    loops = stored(pairs.filter("source_id = target_id").select(F.col("source_id").alias("id")))
    alone = loops.select("id", F.col("id").alias("component"))
    with BlockGraph(pairs.filter("source_id <> target_id"), **sizes) as graph:
        if not graph.blocks:
            return alone
        while graph.run(_trim_step):
            graph.run(_label_step)
            graph.run(_decide_step)
        placed = graph.nodes.filter(F.col("kind") == NODE).select("id", "num")
        found = stored(graph.values(_components, "num long, component long").join(placed, "num"))
        # Relays come after all nodes in number, so none is the least of a component with a node in it. A node that was
        # found alone lies between cycles.
        several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
        named = several.join(placed.withColumnRenamed("num", "component"), "component").select("component", F.col("id").alias("least"))
        members = stored(found.join(named, "component").select("id", F.col("least").alias("component")))
    return members.union(alone.join(members.select("id"), "id", "left_anti"))


NOWHERE = np.iinfo(np.int64).max


def _fresh_components(part: Part) -> State:
    return {
        "alive": np.ones(part.size, bool),
        "out": np.ones(len(part.out_to), bool),
        "in": np.ones(len(part.in_from), bool),
        "component": np.full(part.size, NOWHERE),
    }


def _labels_of(part: Part, state: State, nodes: np.ndarray) -> np.ndarray:
    """The labels of ``nodes``, here or as their blocks sent them; NOWHERE for those that are gone."""
    found = np.full((len(nodes), 2), NOWHERE)
    local = nodes - part.first
    here = np.flatnonzero((local >= 0) & (local < part.size))
    here = here[state["alive"][local[here]]]
    found[here, 0], found[here, 1] = state["up"][local[here]], state["down"][local[here]]
    sent = state["sent"]
    if len(sent):
        at = np.minimum(np.searchsorted(sent[:, 0], nodes), len(sent) - 1)
        same = sent[at, 0] == nodes
        found[same] = sent[at[same], 1:]
    return found


def _trim_step(part: Part, state: State | None, inbox: list[np.ndarray]) -> tuple[State, int, np.ndarray]:
    """Remove nodes without inputs or without outputs, on and on. Messages are ``node, inputs lost, outputs lost``."""
    begins = not inbox and (state is None or "n_in" not in state)
    if begins:
        if state is None:
            state = _fresh_components(part)
        elif "up" in state:
            # Edges live on if both ends do and have the same labels.
            for ptr, other, edge in ((part.out_ptr, part.out_to, "out"), (part.in_ptr, part.in_from, "in")):
                own = np.repeat(np.arange(part.size), np.diff(ptr))
                theirs = _labels_of(part, state, other)
                state[edge] &= state["alive"][own] & (theirs[:, 0] == state["up"][own]) & (theirs[:, 1] == state["down"][own])
            for name in ("up", "down", "sent"):
                del state[name]
        for ptr, edge, name in ((part.out_ptr, "out", "n_out"), (part.in_ptr, "in", "n_in")):
            state[name] = np.diff(np.concatenate([[0], state[edge].cumsum()])[ptr])
    alive, n_in, n_out = state["alive"], state["n_in"], state["n_out"]
    for message in inbox:
        node = message[:, 0] - part.first
        n_in[node] -= message[:, 1]
        n_out[node] -= message[:, 2]
    gone = np.flatnonzero(alive & ((n_in <= 0) | (n_out <= 0)))
    away = []
    while len(gone):
        alive[gone] = False
        touched = []
        for ptr, other, edge, count, lost in ((part.out_ptr, part.out_to, "out", n_in, (1, 0)), (part.in_ptr, part.in_from, "in", n_out, (0, 1))):
            at, _ = edges_of(ptr, gone)
            target = other[at[state[edge][at]]]
            node = target - part.first
            here = (node >= 0) & (node < part.size)
            far = target[~here]
            away.append(np.stack([far, np.full(len(far), lost[0]), np.full(len(far), lost[1])], axis=1))
            np.subtract.at(count, node[here], 1)
            touched.append(node[here])
        node = np.unique(np.concatenate(touched))
        gone = node[alive[node] & ((n_in[node] <= 0) | (n_out[node] <= 0))]
    return state, int(alive.sum()), _combined(away, (np.add, np.add))


def _label_step(part: Part, state: State, inbox: list[np.ndarray]) -> tuple[State, int, np.ndarray]:
    """Spread the smallest number along the edges and against them. Messages are ``node, up, down``."""
    alive = state["alive"]
    if "up" not in state:
        own = np.where(alive, np.arange(part.size) + part.first, NOWHERE)
        state |= {"up": own, "down": own.copy(), "sent": np.zeros((0, 3), np.int64)}
        changed = {"up": np.flatnonzero(alive), "down": np.flatnonzero(alive)}
    else:
        changed = {"up": np.zeros(0, np.int64), "down": np.zeros(0, np.int64)}
        for message in inbox:
            node = message[:, 0] - part.first
            for column, name in ((1, "up"), (2, "down")):
                better = alive[node] & (message[:, column] < state[name][node])
                state[name][node[better]] = message[better, column]
                changed[name] = np.append(changed[name], node[better])
    away = []
    for name, ptr, other, edge in (("up", part.out_ptr, part.out_to, "out"), ("down", part.in_ptr, part.in_from, "in")):
        label, todo, moved = state[name], np.unique(changed[name]), np.zeros(part.size, bool)
        while len(todo):
            moved[todo] = True
            at, source = edges_of(ptr, todo)
            kept = state[edge][at]
            node, offer = other[at[kept]] - part.first, label[source[kept]]
            here = (node >= 0) & (node < part.size)
            node, offer = node[here], offer[here]
            better = alive[node] & (offer < label[node])
            node, offer = node[better], offer[better]
            np.minimum.at(label, node, offer)
            todo = np.unique(node)
        at, source = edges_of(ptr, np.flatnonzero(moved))
        kept = state[edge][at]
        target, offer = other[at[kept]], label[source[kept]]
        far = (target < part.first) | (target >= part.first + part.size)
        sides = [target[far], offer[far], np.full(far.sum(), NOWHERE)]
        away.append(np.stack(sides if name == "up" else [sides[0], sides[2], sides[1]], axis=1))
    return state, 0, _combined(away, (np.minimum, np.minimum))


def _decide_step(part: Part, state: State, inbox: list[np.ndarray]) -> tuple[State, int, np.ndarray]:
    """Nodes with equal labels are found. The others tell their neighbours' blocks their labels: ``node, up, down``, sent to ``node``'s neighbours."""
    if inbox:
        rows = np.concatenate(inbox)[:, 1:]
        state["sent"] = rows[np.unique(rows[:, 0], return_index=True)[1]]
        return state, 0, np.zeros((0, 4), np.int64)
    alive = state["alive"]
    found = alive & (state["up"] == state["down"])
    state["component"][found] = state["up"][found]
    alive &= ~found
    for name in ("n_in", "n_out"):
        del state[name]
    away, nodes = [], np.flatnonzero(alive)
    for ptr, other, edge in ((part.out_ptr, part.out_to, "out"), (part.in_ptr, part.in_from, "in")):
        at, source = edges_of(ptr, nodes)
        kept = state[edge][at]
        target, source = other[at[kept]], source[kept]
        far = (target < part.first) | (target >= part.first + part.size)
        source = source[far]
        away.append(np.stack([target[far], source + part.first, state["up"][source], state["down"][source]], axis=1))
    return state, 0, np.concatenate(away)


def _components(part: Part, state: State) -> list[np.ndarray]:
    known = np.flatnonzero(state["component"] != NOWHERE)
    return [known + part.first, state["component"][known]]


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, level, position)``, sources before targets. A cycle is an error that names its nodes."""
    levels, waiting = _levels(nodes, edges)
    if waiting:
        some = cyclic_components(edges).orderBy("component", "id").limit(20).collect()
        raise ValueError(f"the graph has a cycle: {[(r.component, r.id) for r in some]}")
    return with_position(levels, ["level", "id"])


def order_violations(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges whose source does not come before their target in ``order(id, position)``."""
    return _placed(edges, order).filter(F.col("source_position") >= F.col("target_position"))


def order_check(edges: DataFrame, order: DataFrame) -> DataFrame:
    """``(n_edges, n_violations)``; an order is valid when the second is 0."""
    return _placed(edges, order).agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_if(F.col("source_position") >= F.col("target_position")).alias("n_violations"),
    )


def _placed(edges: DataFrame, order: DataFrame) -> DataFrame:
    source = order.select(F.col("id").alias("source_id"), F.col("position").alias("source_position"))
    target = order.select(F.col("id").alias("target_id"), F.col("position").alias("target_position"))
    return edges.select("source_id", "target_id").join(source, "source_id").join(target, "target_id")
