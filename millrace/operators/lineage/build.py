"""Edges and node ids from task sources, and tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import module_path
from millrace.operators.ranking import paged_lists, with_position

# How a task source refers to another task, by position or by keyword.
REF_CALL = r"\bCurrentRun\s*\.\s*ref\s*\("
REF_ARGUMENT = REF_CALL + r"\s*(?:task_id\s*=\s*)?[\"']([^\"'\n]*)[\"']\s*,?\s*\)"
# Blocks of text in three quotes and comments go, texts in one pair of quotes stay: whichever begins first.
NO_CODE = r"""\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|(\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')|#[^\n]*+"""


def ref_edges(sources: DataFrame, target: str = "id", text: str = "text") -> DataFrame:
    """``(source_id, target_id, place)`` for each reference in each task source, in code order.

    Comments and blocks of text in three quotes are ignored. A reference counts wherever else it occurs in the task.
    """
    code = F.regexp_replace(text, NO_CODE, "$1")
    calls = F.regexp_extract_all(code, F.lit(REF_ARGUMENT), F.lit(1))
    found = sources.select(F.col(target).alias("target_id"), F.posexplode(calls).alias("place", "source_id"))
    return found.select("source_id", "target_id", "place")


def unclear_refs(sources: DataFrame, target: str = "id", text: str = "text") -> DataFrame:
    """Tasks with reference calls whose argument is not one literal text: ``(id, n_calls, n_clear)``."""
    code = F.regexp_replace(text, NO_CODE, "$1")
    counted = sources.select(
        F.col(target).alias("id"),
        F.regexp_count(code, F.lit(REF_CALL)).alias("n_calls"),
        F.regexp_count(code, F.lit(REF_ARGUMENT)).alias("n_clear"),
    )
    return counted.filter(F.col("n_calls") != F.col("n_clear"))


def link_edges(pages: DataFrame, page: str, html: str) -> DataFrame:
    """``(source_id, target_id)`` for each double-quoted ``href`` of each page."""
    links = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(F.col(page).alias("source_id"), F.explode(links).alias("target_id"))


def node_id(path: Column, name: Column, explicit: Column | None = None) -> Column:
    """The explicit id, or module path and name joined by a dot."""
    default = F.concat(module_path(path), F.lit("."), name)
    return default if explicit is None else F.coalesce(explicit, default)


def nodes_and_edges(tasks: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes, with and without references, and distinct edges."""
    edges = refs.select("source_id", "target_id").distinct()
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id"))
    return tasks.select("id").union(ends).distinct(), edges


def adjacency(nodes: DataFrame, edges: DataFrame, page_size: int = 1000) -> DataFrame:
    """``(id, page, refs)``: the sources of each node, sorted; an empty list when it has none."""
    lists = paged_lists(
        edges.select(F.col("target_id").alias("id"), "source_id").distinct(), ["id"], "source_id", page_size, "refs"
    )
    bare = nodes.select("id").distinct().join(edges.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")
    kind = edges.schema["source_id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>").alias("refs")
    return lists.unionByName(bare.select("id", F.lit(0).cast("bigint").alias("page"), none))


def position_of_total(tasks: DataFrame, order_by: list[str], within: list[str] | None = None) -> DataFrame:
    """Tasks with ``position`` and ``total``: the "i of N" of a run."""
    return with_position(tasks, order_by, within or [], total="total")


def task_module_counts(tasks: DataFrame) -> DataFrame:
    """``(n_tasks, n_modules)`` of tasks given by ``id`` and ``path``."""
    return tasks.select("id", "path").agg(
        F.count("id").alias("n_tasks"), F.count_distinct("path").alias("n_modules")
    )


def manifest(tasks: DataFrame, edges: DataFrame, targets: DataFrame, page_size: int = 1000) -> DataFrame:
    """What a project consists of, as JSON: ``(section, folder, module, task_id, page, items)``.

    ``tasks(id, path)`` lists the tasks of each module, ``edges`` give the refs of each task and
    ``targets(task_id, loc)`` the places it writes to. Lists are sorted and without repeats. Refs and
    targets have a row for every task, with an empty list when there is none.
    """
    parts = F.split(module_path(F.col("path")), "/")
    folder = F.when(
        F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), F.lit("/"))
    )
    placed = tasks.select(
        "id", F.coalesce(folder, F.lit("")).alias("folder"), F.element_at(parts, -1).alias("module")
    ).distinct()
    by_module = paged_lists(placed, ["folder", "module"], "id", page_size, "items").select(
        F.lit("tasks").alias("section"), "folder", "module", F.lit(None).cast("string").alias("task_id"), "page", "items"
    )
    refs = edges.select(F.col("target_id").alias("task_id"), F.col("source_id").alias("item"))
    locs = targets.select("task_id", F.col("loc").alias("item"))
    both = refs.select(F.lit("refs").alias("section"), "*").union(locs.select(F.lit("targets").alias("section"), "*"))
    lists = paged_lists(both.distinct(), ["section", "task_id"], "item", page_size, "items")
    sections = F.explode(F.array(F.lit("refs"), F.lit("targets"))).alias("section")
    per_task = (
        placed.select(F.col("id").alias("task_id"), "folder", "module", sections)
        .join(lists, ["section", "task_id"], "left")
        .select(
            "section", "folder", "module", "task_id",
            F.coalesce("page", F.lit(0)).alias("page"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
    return by_module.unionByName(per_task).withColumn("items", F.to_json("items"))


def manifest_tree(tasks: DataFrame, edges: DataFrame, targets: DataFrame, page_size: int = 1000) -> DataFrame:
    """The manifest by folder, at every depth: ``(folder, depth, page, n_tasks, n_modules, n_refs, n_targets, items)``.

    ``tasks(id, path)``, ``edges`` and ``targets(task_id, loc)`` are as for ``manifest``. Counts cover all that lies below a folder; ``items``
    lists what lies directly in it, folders with a slash at their end, in pages. The root is the folder ``""`` at depth 0. Tasks are
    counted up to their folders first; only rows of folders then go to the folders above them, in one shuffle whatever the depth.
    """
    refs = edges.select(F.col("target_id").alias("id"), "source_id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_refs"))
    locs = targets.select(F.col("task_id").alias("id"), "loc").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_targets"))
    parts = F.split(module_path(F.col("path")), "/")
    placed = tasks.select("id", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("_above"), F.element_at(parts, -1).alias("module")).distinct()
    counted = placed.join(refs, "id", "left").join(locs, "id", "left")
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("n_refs", "n_targets")]
    modules = counted.groupBy("_above", "module").agg(F.count(F.lit(1)).alias("n_tasks"), *sums)
    numbers = ["n_tasks", "n_modules", "n_refs", "n_targets"]
    direct = modules.withColumn("n_modules", F.lit(1).cast("bigint")).groupBy("_above").agg(*(F.sum(n).alias(n) for n in numbers))
    depths = F.sequence(F.lit(0), F.size("_above"))
    above = direct.select(F.explode(F.transform(depths, lambda d: F.slice("_above", F.lit(1), d))).alias("_parts"), *numbers)
    totals = above.groupBy("_parts").agg(*(F.sum(n).alias(n) for n in numbers))

    def name(parts: Column) -> Column:
        return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.array_join(parts, "/"), F.lit("/")))

    upper = F.slice("_parts", F.lit(1), F.size("_parts") - 1)
    inside = totals.filter(F.size("_parts") > 0).select(name(upper).alias("folder"), F.concat(F.element_at("_parts", -1), F.lit("/")).alias("item"))
    inside = inside.union(modules.select(name(F.col("_above")).alias("folder"), F.col("module").alias("item")))
    items = paged_lists(inside, ["folder"], "item", page_size, "items")
    named = totals.select(name(F.col("_parts")).alias("folder"), F.size("_parts").cast("bigint").alias("depth"), *numbers)
    return named.join(items, "folder").select("folder", "depth", "page", *numbers, F.to_json("items").alias("items"))
