"""Graph operators on known graphs, on random ones against plain Python, and on graphs with hubs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators.lineage import blocks, build, checks, order, reach, rounds
from millrace.operators.lineage.rounds import EdgeTable, RoundTable

SIXTEEN = [
    ("01", "02"), ("01", "03"), ("02", "04"), ("03", "04"), ("01", "05"), ("05", "06"), ("04", "07a"),
    ("06", "07a"), ("07a", "07b"), ("01", "08"), ("05", "09"), ("08", "09"), ("01", "10"), ("07a", "11"),
    ("10", "11"), ("10", "12"), ("10", "13"), ("11", "14"), ("11", "15"),
]
CYCLE = [
    ("A", "B"), ("E", "B"), ("A", "C"), ("B", "D"), ("A", "D"), ("C", "D"), ("A", "E"), ("C", "E"), ("D", "E"),
]


def edges_of(spark, pairs):
    kind = "string" if pairs and isinstance(pairs[0][0], str) else "bigint"
    return spark.createDataFrame(pairs, f"source_id {kind}, target_id {kind}")


def nodes_of(spark, ids, kind=None):
    ids = list(ids)
    return spark.createDataFrame([(i,) for i in ids], f"id {kind or ('string' if isinstance(ids[0], str) else 'bigint')}")


def ids(df):
    rows = [r.id for r in df.select("id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def walk(pairs, seeds, forward=True):
    step = {}
    for a, b in pairs:
        step.setdefault(a if forward else b, set()).add(b if forward else a)
    seen, todo = set(seeds), list(seeds)
    while todo:
        for n in step.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def components(pairs):
    """Every node on a cycle with the smallest id of its component, by mutual reachability."""
    nodes = {n for p in pairs for n in p}
    down = {n: walk(pairs, [m for a, m in pairs if a == n]) for n in nodes}
    return {n: min(m for m in down[n] if n in down[m]) for n in nodes if n in down[n]}


def test_upstream_of_a_known_node(spark):
    found = reach.upstream(edges_of(spark, SIXTEEN), nodes_of(spark, ["07a"]))
    assert ids(found) == {"01", "02", "03", "04", "05", "06", "07a"}
    assert {r.id: r.distance for r in found.collect()}["01"] == 3


def test_downstream_of_a_known_node(spark):
    assert ids(reach.downstream(edges_of(spark, SIXTEEN), nodes_of(spark, ["07a"]))) == {"07a", "07b", "11", "14", "15"}


def test_selection_sets(spark):
    edges, seeds = edges_of(spark, SIXTEEN), nodes_of(spark, ["10", "10"])
    nodes = order.endpoints(edges)
    assert ids(reach.select_nodes(nodes, edges)) == ids(nodes)
    picked = reach.select_nodes(nodes, edges, seeds)
    assert ids(picked) == {"01", "10"}
    status = {r.id: r.status for r in reach.selection_status(picked, seeds).collect()}
    assert status == {"01": "UPSTREAM_ONLY", "10": "EXPLICIT"}
    both = reach.select_nodes(nodes, edges, seeds, with_downstream=True)
    assert ids(both) == {"01", "10", "11", "12", "13", "14", "15"}
    assert {r.status for r in reach.selection_status(both, seeds, True).collect()} == {"EXPLICIT"}
    kept = reach.induced_subgraph(edges, picked)
    assert [tuple(r) for r in kept.collect()] == [("01", "10")]


def test_topological_order(spark):
    edges = edges_of(spark, SIXTEEN)
    placed = {r.id: r.position for r in order.topological_order(nodes_of(spark, ["00", "01"]), edges).collect()}
    assert sorted(placed.values()) == list(range(1, 18)) and placed["00"] == 1
    assert all(placed[a] < placed[b] for a, b in SIXTEEN)


def test_order_violations_are_found(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c")])
    wrong = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "id string, position bigint")
    assert [(r.source_id, r.target_id) for r in order.order_violations(edges, wrong).collect()] == [("a", "b")]
    assert tuple(order.order_check(edges, wrong).first()) == (2, 1)


def test_nodes_without_edges(spark):
    none = spark.createDataFrame([], "source_id string, target_id string")
    nodes = nodes_of(spark, "ABCDE")
    assert [r.id for r in order.topological_order(nodes, none).orderBy("position").collect()] == list("ABCDE")
    assert order.cyclic_components(none).count() == 0
    assert ids(reach.upstream(none, nodes)) == set("ABCDE")


def test_cycle(spark):
    edges = edges_of(spark, CYCLE)
    assert {r.id: r.component for r in order.cyclic_components(edges).collect()} == {"B": "B", "D": "B", "E": "B"}
    with pytest.raises(ValueError, match="cycle"):
        order.topological_order(order.endpoints(edges), edges)
    assert ids(reach.downstream(edges, nodes_of(spark, ["B"]))) == {"B", "D", "E"}


def test_self_reference_is_a_cycle(spark):
    edges = edges_of(spark, [("A", "B"), ("B", "B"), ("B", "C")])
    assert [tuple(r) for r in order.cyclic_components(edges).collect()] == [("B", "B")]
    with pytest.raises(ValueError, match="cycle"):
        order.topological_order(order.endpoints(edges), edges)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    dag = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    edges, seeds = edges_of(spark, dag), rng.sample(range(40), 3)
    assert ids(reach.downstream(edges, nodes_of(spark, seeds))) == walk(dag, seeds)
    assert ids(reach.upstream(edges, nodes_of(spark, seeds))) == walk(dag, seeds, forward=False)
    placed = order.topological_order(nodes_of(spark, range(40)), edges)
    assert order.order_check(edges, placed).first().n_violations == 0


@pytest.mark.parametrize("seed", range(4))
def test_random_cyclic_graphs(spark, seed):
    rng = random.Random(100 + seed)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(25 + 10 * seed)})
    found = order.cyclic_components(edges_of(spark, pairs))
    assert {r.id: r.component for r in found.collect()} == components(pairs)


def test_hub_is_spread_over_buckets(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 400)] + [(5000, 0)]
    edges, seeds = edges_of(spark, pairs), nodes_of(spark, [5000])
    assert ids(reach.downstream(edges, seeds, rows_per_task=50)) == walk(pairs, [5000])
    with EdgeTable(edges, "source_id", rows_per_task=50) as table:
        assert [tuple(r) for r in table.hot.collect()] == [(0, 8)]
        files = spark.table(table.name).filter("from_id = 0").select(F.input_file_name()).distinct().count()
        assert files > 1


def test_a_round_shuffles_only_what_it_found(spark):
    edges = edges_of(spark, [(i, i + 1) for i in range(50)])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with EdgeTable(edges, "source_id") as walk_table, RoundTable(spark, "t") as seen:
            seen.append(nodes_of(spark, [1]), 0)
            found = walk_table.step(seen.at(0).select("id")).select(F.col("to_id").alias("id")).distinct()
            new = found.join(seen.all().select("id"), "id", "left_anti")
            plan = new._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_too_many_rounds_is_an_error(spark):
    edges = edges_of(spark, [(i, i + d) for i in range(12) for d in (1, 2)])
    with pytest.raises(RuntimeError, match="3 rounds"):
        reach.downstream(edges, nodes_of(spark, [0]), max_rounds=3)


def plain_distances(pairs, seeds):
    at = {s: 0 for s in seeds}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in at and at[a] + 1 < at.get(b, 1 << 60):
                at[b], changed = at[a] + 1, True
    return at


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contracted_paths_keep_their_distances(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(12), r.randrange(12)) for _ in range(14)]
    new = 100
    for _ in range(10):  # unbranched paths between nodes that are there, some of them dead ends or circles
        length, a, b = r.randrange(1, 9), r.randrange(14), r.randrange(14)
        nodes = [a, *range(new, new + length), b]
        new += length
        pairs += list(zip(nodes, nodes[1:]))
    pairs += [(900, 901), (901, 902), (902, 900)]  # a circle that nothing enters
    seeds = [0, 103] + ([901] if seed == 2 else [])
    pairs = list(dict.fromkeys(pairs))
    found = {row.id: row.distance for row in reach.downstream(edges_of(spark, pairs), nodes_of(spark, seeds)).collect()}
    assert found == plain_distances(pairs, seeds)


def input_bytes(spark):
    """Bytes that all stages so far have read."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    n, found_in, read = 10_000, [], []
    names = list(range(n))
    random.Random(7).shuffle(names)
    append = RoundTable.append

    def counted(self, df, *args, **kw):
        before = input_bytes(spark)
        out = append(self, df, *args, **kw)
        found_in.append(out["n"])
        read.append(input_bytes(spark) - before)
        return out

    monkeypatch.setattr(RoundTable, "append", counted)
    edges = edges_of(spark, list(zip(names, names[1:])))
    found = {row.id: row.distance for row in reach.downstream(edges, nodes_of(spark, [names[0]])).collect()}
    assert found == {name: i for i, name in enumerate(names)}
    assert len(found_in) <= 20 and max(read) < 4 << 20


def test_a_step_from_few_nodes_opens_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(rounds, "PRUNED_BYTES", 0)
    ids_ = spark.range(400_000).selectExpr("xxhash64(id) AS source_id", "xxhash64(id, 1) AS target_id", "id")
    first = ids_.filter("id = 5").first()
    with EdgeTable(ids_.drop("id"), "source_id") as table, RoundTable(spark, "t") as seen:
        seen.append(nodes_of(spark, [first.source_id]), 0)
        frontier = seen.at(0).select("id")

        def bytes_of(n_ids):
            before = input_bytes(spark)
            assert [r.to_id for r in table.step(frontier, n_ids).collect()] == [first.target_id]
            return input_bytes(spark) - before

        whole, few = bytes_of(None), bytes_of(1)
        assert few < whole / 4, (few, whole)


@pytest.mark.parametrize("ends", ["source_id", "target_id"])
def test_closure_rounds_follow_the_branches(spark, ends):
    ladder = [(i, i + 1) for i in range(5)] + [(i, i + 2) for i in range(4)]
    tail = [(5, 50)] + [(i, i + 1) for i in range(50, 90)]
    pairs = ladder + tail
    forward = ends == "source_id"
    found = reach.closure(edges_of(spark, pairs), nodes_of(spark, [0 if forward else 90]), ends, max_rounds=10)
    assert ids(found) == walk(pairs, [0 if forward else 90], forward)


def plain_levels(pairs, nodes):
    need, out, level = {}, {}, {}
    for a, b in set(pairs):
        need[b] = need.get(b, 0) + 1
        out.setdefault(a, []).append(b)
    todo = [n for n in nodes if not need.get(n)]
    level = {n: 0 for n in todo}
    while todo:
        a = todo.pop()
        for b in out.get(a, ()):
            level[b] = max(level.get(b, 0), level[a] + 1)
            need[b] -= 1
            if not need[b]:
                todo.append(b)
    return {n: lv for n, lv in level.items() if not need.get(n)}


@pytest.mark.parametrize(("seed", "per_block", "hub"), [(1, 1, 1000), (2, 7, 3), (3, 1000, 2), (4, 5, 1000)])
def test_levels_and_components_in_blocks(spark, monkeypatch, seed, per_block, hub):
    """Small blocks, and nodes with more edges than a relay takes."""
    monkeypatch.setattr(order, "BlockGraph", lambda edges, **_: blocks.BlockGraph(edges, edges_per_block=per_block, hub_edges=hub))
    r = random.Random(seed)
    name = (lambda i: f"n{i:03d}") if seed % 2 else (lambda i: i)
    pairs = [(name(r.randrange(40)), name(r.randrange(40))) for _ in range(55)] + [(name(3), name(i)) for i in range(4, 30)]
    assert {row.id: row.component for row in order.cyclic_components(edges_of(spark, pairs)).collect()} == components(pairs)
    nodes = [name(i) for i in range(45)]
    got = {row.id: row.level for row in order.reachable_levels(nodes_of(spark, nodes), edges_of(spark, pairs)).collect()}
    assert got == plain_levels(pairs, nodes)
    down = [(a, b) for a, b in pairs if a < b]
    got = {row.id: row.level for row in order.reachable_levels(nodes_of(spark, nodes), edges_of(spark, down)).collect()}
    assert got == plain_levels(down, nodes)


def test_levels_inside_a_block_take_no_rounds(spark):
    pairs = [(i, i + 1) for i in range(4000)]
    edges = edges_of(spark, pairs)
    with blocks.BlockGraph(edges) as graph:
        graph.run(order._level_step)
        assert graph.rounds <= len(graph.blocks) + 1
        found = graph.values(order._known_levels, "num long, level long").join(graph.nodes, "num").select("id", "level").collect()
    assert {r.id: r.level for r in found} == {i: i for i in range(4001)}


def test_references_in_task_sources(spark):
    source = '''
class T(Task):
    def func_0(self):
        return CurrentRun.ref("func_0")

    def run(self):
        # CurrentRun.ref("commented")
        a = CurrentRun.ref('hello'); b = engine.runtime.CurrentRun.ref(task_id="world")
        c = CurrentRun.ref(
            "nested/foo.Foo",
        )
        d = OtherCurrentRun.ref("no") + CurrentRun.reference("no")
'''
    df = spark.createDataFrame([("t", source), ("bad", "CurrentRun.ref(name)\nCurrentRun.ref('ok')")], "id string, text string")
    found = [(r.source_id, r.target_id) for r in build.ref_edges(df).orderBy("target_id", "place").collect()]
    assert found == [("ok", "bad"), ("func_0", "t"), ("hello", "t"), ("world", "t"), ("nested/foo.Foo", "t")]
    assert [tuple(r) for r in build.unclear_refs(df).collect()] == [("bad", 2, 1)]


def test_known_graph_from_sources(spark):
    """The sixteen nodes, one source text each, give back their edges."""
    inputs = {}
    for a, b in SIXTEEN:
        inputs.setdefault(b, []).append(a)
        inputs.setdefault(a, [])
    rows = [(n, "".join(f'    x = CurrentRun.ref("{a}")\n' for a in refs)) for n, refs in inputs.items()]
    df = spark.createDataFrame(rows, "id string, text string")
    nodes, edges = build.nodes_and_edges(df, build.ref_edges(df))
    assert sorted(map(tuple, edges.collect())) == sorted(SIXTEEN)
    assert ids(nodes) == set(inputs)
    refs = {r.id: r.refs for r in build.adjacency(nodes, edges).collect()}
    assert refs == {n: sorted(r) for n, r in inputs.items()}


def test_long_lists_continue_on_pages(spark):
    edges = edges_of(spark, [(i, 1000) for i in range(25)] + [(3, 1001)])
    rows = build.adjacency(nodes_of(spark, [1000, 1001, 7]), edges, page_size=10).orderBy("id", "page").collect()
    assert [(r.id, r.page, len(r.refs)) for r in rows] == [(7, 0, 0), (1000, 0, 10), (1000, 1, 10), (1000, 2, 5), (1001, 0, 1)]
    assert [x for r in rows for x in r.refs if r.id == 1000] == list(range(25))


def test_checks(spark):
    tasks = spark.createDataFrame(
        [("a", "m1"), ("a", "m2"), ("b", "m1"), ("b", "m1"), ("c", "m3")], "id string, module string"
    )
    found = {(r.id, r.module): (r.n_rows, r.n_modules) for r in checks.duplicate_ids(tasks).collect()}
    assert found == {("a", "m1"): (1, 2), ("a", "m2"): (1, 2), ("b", "m1"): (2, 1)}
    edges = edges_of(spark, [("a", "b"), ("zz", "b"), ("zz", "c")])
    assert [tuple(r) for r in checks.dangling_refs(tasks, edges).collect()] == [("zz", 2)]
    good = tasks.filter("id = 'c'")
    with pytest.raises(ValueError, match="unique"):
        checks.check_graph(tasks, edges)
    with pytest.raises(ValueError, match="zz"):
        checks.check_graph(good, edges_of(spark, [("zz", "c")]))
    with pytest.raises(ValueError, match="foo"):
        checks.check_graph(good, edges_of(spark, [("c", "c")]), nodes_of(spark, ["foo"]))
    with pytest.raises(ValueError, match="no nodes"):
        checks.check_graph(tasks.filter("false"), edges)


def test_folder_patterns(spark):
    nodes = spark.createDataFrame(
        [("m1", "extract/module01.py"), ("m2", "extract/deep/module02.py"), ("m3", "load/module03.py"),
         ("m4", "module04.py"), ("m5", "re-extract/m.py")], "id string, path string",
    )
    assert ids(reach.select_by_glob(nodes, ["extract/*"])) == {"m1", "m2"}
    table = spark.createDataFrame([("extract/*",), ("extract/deep/*",), ("load/*",)], "glob string")
    assert ids(reach.select_by_glob(nodes, table)) == {"m1", "m2", "m3"}
    with pytest.raises(ValueError, match="pattern"):
        reach.select_by_glob(nodes, ["extract"])


def test_blocked_tasks(spark):
    blocked = reach.blocked_by_failure(edges_of(spark, SIXTEEN), nodes_of(spark, ["10", "11"]))
    assert ids(blocked) == {"12", "13", "14", "15"}


def test_manifest(spark):
    tasks = spark.createDataFrame([("a.A", "a.py"), ("d/b.B", "d/b.py"), ("d/b.C", "d/b.py")], "id string, path string")
    targets = spark.createDataFrame([("d/b.B", "/out/x"), ("d/b.B", "/out/x")], "task_id string, loc string")
    rows = build.manifest(tasks, edges_of(spark, [("a.A", "d/b.B")]), targets).collect()
    got = {(r.section, r.folder, r.module, r.task_id): r["items"] for r in rows}
    assert got == {
        ("tasks", "", "a", None): '["a.A"]',
        ("tasks", "d/", "b", None): '["d/b.B","d/b.C"]',
        ("refs", "", "a", "a.A"): "[]",
        ("refs", "d/", "b", "d/b.B"): '["a.A"]',
        ("refs", "d/", "b", "d/b.C"): "[]",
        ("targets", "", "a", "a.A"): "[]",
        ("targets", "d/", "b", "d/b.B"): '["/out/x"]',
        ("targets", "d/", "b", "d/b.C"): "[]",
    }


def test_references_in_comments_and_blocks_are_no_edges(spark):
    code = '''x = CurrentRun.ref("real")  # CurrentRun.ref("trailing")
"""Docs: CurrentRun.ref("docs")
"""
# CurrentRun.ref("line")
y = "# no comment", CurrentRun.ref('second')
\'\'\'CurrentRun.ref("other")\'\'\'
'''
    got = build.ref_edges(spark.createDataFrame([("t", code)], "id string, text string")).orderBy("place").collect()
    assert [r.source_id for r in got] == ["real", "second"]


def test_graph_checks_include_unclear_references(spark):
    tasks = spark.createDataFrame([("a", "m"), ("b", "m")], "id string, module string")
    edges = edges_of(spark, [("a", "b")])
    clear = spark.createDataFrame([("b", 'CurrentRun.ref("a")')], "id string, text string")
    checks.check_graph(tasks, edges, sources=clear)
    with pytest.raises(ValueError, match="not one literal"):
        checks.check_graph(tasks, edges, sources=spark.createDataFrame([("b", "CurrentRun.ref(a, b)")], "id string, text string"))


def test_manifest_by_folder_at_every_depth(spark):
    tasks = spark.createDataFrame([("a", "top.py"), ("b", "x/m.py"), ("c", "x/m.py"), ("d", "x/y/m.py"), ("e", "x/y/z/n.py"), ("e", "x/y/z/n.py")], "id string, path string")
    edges = edges_of(spark, [("a", "b"), ("a", "b"), ("b", "e"), ("c", "e")])
    targets = spark.createDataFrame([("e", "out"), ("a", "in"), ("a", "in")], "task_id string, loc string")
    got = {(r.folder, r.page): tuple(r)[1:2] + tuple(r)[3:] for r in build.manifest_tree(tasks, edges, targets, page_size=1).collect()}
    assert got == {
        ("", 0): (0, 5, 4, 3, 2, '["top"]'),
        ("", 1): (0, 5, 4, 3, 2, '["x/"]'),
        ("x/", 0): (1, 4, 3, 3, 1, '["m"]'),
        ("x/", 1): (1, 4, 3, 3, 1, '["y/"]'),
        ("x/y/", 0): (2, 2, 2, 2, 1, '["m"]'),
        ("x/y/", 1): (2, 2, 2, 2, 1, '["z/"]'),
        ("x/y/z/", 0): (3, 1, 1, 2, 1, '["n"]'),
    }


def test_rounds_broadcast_no_blocks(spark):
    edges = spark.range(2000).selectExpr("id AS source_id", "id + 1 AS target_id")
    with blocks.BlockGraph(edges, edges_per_block=100) as graph:
        graph.run(order._level_step)
        plan = graph._with_inbox(graph._with_states(), graph._rounds - 2)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_blocks_reach_python_one_at_a_time(spark):
    edges = spark.range(2000).selectExpr("id AS source_id", "id + 1 AS target_id")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    with blocks.BlockGraph(edges, edges_per_block=100) as graph:
        before = spark.conf.get(blocks.BATCH_ROWS)
        with blocks.one_by_one(spark):
            found = [r.n for r in graph._with_states().coalesce(1).select("block", "part").mapInArrow(sizes, "n long").collect()]
        assert found == [1] * len(graph.blocks) and len(found) > 10
        assert spark.conf.get(blocks.BATCH_ROWS) == before
