"""Upstream and downstream closure, and selections built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage.chains import contract
from millrace.operators.lineage.rounds import EdgeTable, RoundTable, check_round
from millrace.operators.skew import ROWS_PER_TASK


def closure(
    edges: DataFrame,
    seeds: DataFrame,
    walk_from: str,
    max_rounds: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Seeds and everything a walk reaches from them: ``(id, distance)``, in steps. Works on any graph.

    Paths without branches are contracted first, so the number of rounds follows the branches, not the length of the walk.
    A round takes up the ids that the one before found, or found nearer than before; without contracted paths that is each id once.
    """
    spark = edges.sparkSession
    other = {"source_id": "target_id", "target_id": "source_id"}[walk_from]
    seeds = seeds.select("id").distinct()
    pairs = edges.select(F.col(walk_from).alias("from_id"), F.col(other).alias("to_id")).filter("from_id <> to_id")
    contracted = contract(pairs, seeds)
    steps = pairs if contracted is None else contracted.edges
    steps = steps.withColumnsRenamed({"from_id": walk_from, "to_id": other})
    with EdgeTable(steps, walk_from, rows_per_task) as walk, RoundTable(spark, "reached") as reached:
        found = reached.append(seeds.select("id", F.lit(0).cast("long").alias("distance")), 0)["n"]
        round_no = 0
        while found:
            check_round(round_no, max_rounds)
            met = walk.step(reached.at(round_no).select("id", "distance"), found)
            if contracted is None:  # what is found again is never nearer
                offers = met.select(F.col("to_id").alias("id")).distinct().withColumn("distance", F.lit(round_no + 1).cast("long"))
                new = offers.join(reached.all().select("id"), "id", "left_anti")
            else:
                offers = met.groupBy(F.col("to_id").alias("id")).agg(F.min(F.col("distance") + F.col("length")).alias("distance"))
                known = reached.all().groupBy("id").agg(F.min("distance").alias("known"))
                new = offers.join(known, "id", "left").filter("known IS NULL OR distance < known").select("id", "distance")
            round_no += 1
            found = reached.append(new, round_no)["n"]
        result = reached.result().select("id", "distance")
    if contracted is None:
        return result
    result = result.groupBy("id").agg(F.min("distance").alias("distance"))
    passed = contracted.inner.join(result.select(F.col("id").alias("entry"), "distance"), "entry")
    return result.union(passed.select("id", (F.col("distance") + F.col("length")).alias("distance")))


def upstream(edges: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """Seeds and all their ancestors."""
    return closure(edges, seeds, "target_id", **options)


def downstream(edges: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """Seeds and all their descendants."""
    return closure(edges, seeds, "source_id", **options)


def select_nodes(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, with_downstream: bool = False
) -> DataFrame:
    """Ids a run has to cover: the seeds, what they need, and if asked what depends on them.

    Without seeds all nodes are selected.
    """
    if seeds is None:
        return nodes.select("id").distinct()
    selected = upstream(edges, seeds).select("id")
    if with_downstream:
        selected = selected.union(downstream(edges, seeds).select("id")).distinct()
    return selected


def selection_status(selected: DataFrame, seeds: DataFrame, whole_direction: bool = False) -> DataFrame:
    """``(id, status)``: EXPLICIT when asked for, UPSTREAM_ONLY when only pulled in.

    With a whole upstream or downstream direction asked for, every selected node is explicit.
    """
    if whole_direction:
        return selected.select("id", F.lit("EXPLICIT").alias("status"))
    asked = seeds.select("id").distinct().withColumn("_asked", F.lit(True))
    status = F.when(F.col("_asked"), "EXPLICIT").otherwise("UPSTREAM_ONLY")
    return selected.select("id").join(asked, "id", "left").select("id", status.alias("status"))


def select_by_glob(nodes: DataFrame, globs: DataFrame | list[str], path: str = "path") -> DataFrame:
    """Nodes whose path lies under the folder of a ``folder/*`` pattern, at any depth.

    A list of patterns, as a user types it, becomes a filter. A table of patterns is joined on
    equal folder names: the folders that occur are few, so each of them is matched once, with all
    folders above it, and the nodes are then joined to the folders found.
    """
    if isinstance(globs, list):
        bad = [g for g in globs if not g.endswith("/*") or len(g) < 3]
        if bad:
            raise ValueError(f"not a folder pattern: {bad}")
        inside = F.lit(False)
        for glob in globs:
            inside = inside | F.col(path).startswith(glob[:-1])
        return nodes.filter(inside)
    placed = nodes.withColumn("_folder", F.regexp_extract(path, "^(.*)/", 1))
    parts = F.split("_folder", "/")
    depths = F.sequence(F.lit(1), F.size(parts))
    above = F.transform(depths, lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))
    wanted = globs.select(F.regexp_replace("glob", r"/\*$", "").alias("_wanted")).distinct()
    occurring = placed.select("_folder").distinct().select("_folder", F.explode(above).alias("_wanted"))
    matched = occurring.join(wanted, "_wanted", "left_semi").select("_folder").distinct()
    return placed.join(matched, "_folder", "left_semi").select(*nodes.columns)


def induced_subgraph(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends selected."""
    ids = selected.select("id").distinct()
    both = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    both = both.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return both.select(*edges.columns)


def blocked_by_failure(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Ids that do not run because something upstream of them failed."""
    reached = downstream(edges, failed)
    return reached.join(failed.select("id"), "id", "left_anti").select("id", F.lit("NOT_RUN").alias("status"))
