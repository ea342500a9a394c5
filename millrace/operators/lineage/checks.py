"""Checks of a dependency graph. Each returns the offending rows; ``require_*`` raises on any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage.build import unclear_refs


def duplicate_ids(tasks: DataFrame) -> DataFrame:
    """Ids declared more than once: ``(id, module, n_rows, n_modules)``, one row per module."""
    per_module = tasks.groupBy("id", "module").agg(F.count(F.lit(1)).alias("n_rows"))
    repeated = (
        per_module.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n_modules"), F.sum("n_rows").alias("_rows"))
        .filter("_rows > 1")
        .drop("_rows")
    )
    return per_module.join(repeated, "id").select("id", "module", "n_rows", "n_modules")


def dangling_refs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Referenced ids that are not nodes: ``(source_id, n_refs)``."""
    refs = edges.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_refs"))
    return refs.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def unknown_seeds(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Selected ids that are not in the graph."""
    return seeds.select("id").distinct().join(nodes.select("id"), "id", "left_anti")


def require_none(violations: DataFrame, message: str, show: int = 20) -> None:
    """Raise if there are any violations; the message has their number and the first few."""
    some = [row.asDict() for row in violations.limit(show).collect()]
    if some:
        raise ValueError(f"{message} ({violations.count()}): {some}")


def require_nodes(nodes: DataFrame) -> None:
    if nodes.isEmpty():
        raise ValueError("the graph has no nodes")


def check_graph(
    tasks: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, sources: DataFrame | None = None
) -> None:
    """All checks a selection needs before it is worth running.

    ``tasks`` has ``id`` and ``module``; ``sources``, if given, ``id`` and ``text``, whose references must be literal.
    """
    require_nodes(tasks)
    if sources is not None:
        require_none(unclear_refs(sources), "references that are not one literal text")
    require_none(duplicate_ids(tasks), "task ids must be unique")
    require_none(dangling_refs(tasks, edges), "references to unknown tasks")
    if seeds is not None:
        require_none(unknown_seeds(tasks, seeds), "unknown tasks selected")
