"""Ledger tables of projects, runs, tasks and task runs: inserts, updates, history and navigation.

Each function takes the table as it is and returns the table as it should be, or the rows to add.
Plain files have no transactions: write the result to a new folder and let one writer publish it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The legal states of a run and of a task run.
RUN_STATUSES = ("PENDING", "RUNNING", "SUCCEEDED", "FAILED")
TASK_RUN_STATUSES = (*RUN_STATUSES, "SKIPPED")


def latest_by(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The last row of each key. Rows combine before the shuffle, so a key's history may be long."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order_by)).alias("_last")
    return df.groupBy(*keys).agg(last).select(
        *(F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns)
    )


def one_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order_by``, or without it the same one on every run."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    if order_by:
        pick = F.min_by(F.struct(*rest), F.struct(*order_by))
    else:
        # As text, since maps have no order.
        pick = F.max_by(F.struct(*rest), F.to_json(F.struct(*rest)))
    picked = df.groupBy(*keys).agg(pick.alias("_row"))
    return picked.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> tuple[Column, DataFrame]:
    """A null-safe join condition, and ``right`` with its key columns renamed."""
    renamed = right.select(*(F.col(c).alias(f"_{c}") if c in columns else F.col(c) for c in right.columns))
    return reduce(and_, (left[c].eqNullSafe(renamed[f"_{c}"]) for c in columns)), renamed


def _without(df: DataFrame, others: DataFrame, columns: Sequence[str]) -> DataFrame:
    condition, renamed = _same(df, others.select(*columns).distinct(), columns)
    return df.join(renamed, condition, "left_anti")


def new_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Rows of ``incoming`` to append: one for each key that is not in the ledger yet. NULL keys match each other."""
    return _without(one_per_key(incoming, keys, order_by), existing, keys).select(*incoming.columns)


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Add the keys that are not there yet. Of several rows of a key the first by ``order_by`` is recorded."""
    return existing.unionByName(new_rows(existing, incoming, keys, order_by))


def key_conflicts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``incoming`` that are taken, or that it holds more than once: ``(keys..., reason)``. NULL keys match each other."""
    counted = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counted.filter("_n > 1").select(*keys, F.lit("repeated").alias("reason"))
    condition, renamed = _same(counted, existing.select(*keys), keys)
    taken = counted.join(renamed, condition, "left_semi")
    return taken.select(*keys, F.lit("taken").alias("reason")).unionByName(repeated)


def insert_unique(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append ``incoming``; a key that exists already is an error."""
    bad = key_conflicts(existing, incoming, keys)
    some = bad.limit(20).collect()
    if some:
        raise ValueError(f"{bad.count()} keys are not unique, among them: {[tuple(r) for r in some]}")
    return existing.unionByName(incoming)


def soft_delete_upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], covered: DataFrame | None = None
) -> DataFrame:
    """``existing`` with ``current``: whether a key is still declared; undeclared keys stay, new ones are added.

    ``covered`` holds the projects (or other key columns) that ``incoming`` speaks for, also those for which it
    declares nothing any more. Rows of other projects stay as they are. Without it, those in ``incoming`` are covered.
    Other columns of ``existing`` stay; an added row takes them from ``incoming``, or NULL.
    """
    covered = incoming.select(keys[0]) if covered is None else covered
    scope = covered.columns
    declared = incoming.select(*keys).distinct().withColumn("_declared", F.lit(True))
    if "current" not in existing.columns:
        existing = existing.withColumn("current", F.lit(True))
    condition, renamed = _same(existing, covered.distinct().withColumn("_covered", F.lit(True)), scope)
    marked = existing.join(renamed, condition, "left").select(*existing.columns, "_covered")
    condition, renamed = _same(marked, declared, keys)
    marked = marked.join(renamed, condition, "left")
    current = F.when(F.col("_covered"), F.col("_declared").isNotNull()).otherwise(F.col("current")).alias("current")
    known = marked.select(*(current if c == "current" else F.col(c) for c in existing.columns))
    fresh = new_rows(existing, incoming, keys)
    types = dict(existing.dtypes)
    added = fresh.select(
        *(
            F.lit(True).alias(c) if c == "current" else F.col(c) if c in fresh.columns else F.lit(None).cast(types[c]).alias(c)
            for c in existing.columns
        )
    )
    return known.unionByName(added)


def replace_by_key(
    existing: DataFrame, replacement: DataFrame, keys: Sequence[str], covered: DataFrame | None = None
) -> DataFrame:
    """Drop all rows of the covered keys, then add the replacement's.

    ``covered`` holds the keys to replace, also those that have no rows any more; without it, those in ``replacement``.
    """
    return _without(existing, replacement if covered is None else covered, keys).unionByName(replacement)


def sync_projects(
    recorded: Mapping[str, DataFrame], declared: Mapping[str, DataFrame], projects: DataFrame
) -> dict[str, DataFrame]:
    """``tasks``, ``refs`` and ``targets`` of a ledger after some projects were compiled again.

    ``projects`` is ``(project_id)`` of these projects. Their tasks are switched on or off or added; their refs and
    targets are replaced, by nothing where nothing is declared. Other projects stay as they are.
    """
    covered = projects.select("project_id").distinct()
    return {
        "tasks": soft_delete_upsert(recorded["tasks"], declared["tasks"], ["project_id", "task_id"], covered),
        "refs": replace_by_key(recorded["refs"], declared["refs"], ["project_id"], covered),
        "targets": replace_by_key(recorded["targets"], declared["targets"], ["project_id"], covered),
    }


def update_status(
    existing: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """The ledger with the status of each updated key replaced.

    Of several updates of a key the last by ``order_by`` counts; without it, different ones fail the job.
    """
    if order_by:
        last = F.max_by("status", F.struct(*order_by))
    else:
        unclear = F.raise_error(F.lit("several states for one key and no order")).cast("string")
        last = F.when(F.min("status").eqNullSafe(F.max("status")), F.max("status")).otherwise(unclear)
    fresh = updates.groupBy(*keys).agg(last.alias("_status"))
    condition, renamed = _same(existing, fresh, keys)
    joined = existing.join(renamed, condition, "left")
    status = F.coalesce("_status", "status").alias("status")
    return joined.select(*(status if c == "status" else F.col(c) for c in existing.columns))


def latest_status(changes: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``(keys..., status)`` after all changes; ``order_by`` must break ties."""
    return changes.groupBy(*keys).agg(F.max_by("status", F.struct(*order_by)).alias("status"))


def derive_status(done: Column, explicit: Column, failed: Column, finished: Column) -> Column:
    """Status of a task run: skipped if its result exists or nobody asked for it, else how far it got."""
    return (
        F.when(done | ~explicit, "SKIPPED").when(failed, "FAILED").when(finished, "SUCCEEDED").otherwise("RUNNING")
    )


def status_violations(df: DataFrame, legal: Sequence[str] = TASK_RUN_STATUSES) -> DataFrame:
    """Rows whose status is missing or not a legal one."""
    return df.filter(F.col("status").isNull() | ~F.col("status").isin(*legal))


def navigate(projects: DataFrame, runs: DataFrame, task_runs: DataFrame) -> DataFrame:
    """Task runs with their run and project.

    Runs get their project first, as they are far fewer. A run that holds very much is a skewed
    partition, which adaptive execution splits.
    """
    shared = [c for c in ("project_id", "run_slug") if c in task_runs.columns]
    return task_runs.join(runs.join(projects, "project_id"), shared)


def of_project(projects: DataFrame, members: DataFrame) -> DataFrame:
    """Tasks, refs, targets or runs with the columns of their project."""
    return members.join(projects, "project_id")


def of_task(tasks: DataFrame, task_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """Task runs with their task, found through the project of their run."""
    placed = task_runs if "project_id" in task_runs.columns else task_runs.join(runs.select("run_slug", "project_id"), "run_slug")
    return placed.join(tasks, ["project_id", "task_id"])


def failed_tasks(task_runs: DataFrame, run_slug: str) -> DataFrame:
    """``(id)`` of the tasks that failed in a run: what keeps the tasks behind them from running."""
    return lookup(task_runs, run_slug=run_slug, status="FAILED").select(F.col("task_id").alias("id")).distinct()


def lookup(df: DataFrame, **equals) -> DataFrame:
    """Rows in which every named column has the given value."""
    return df.filter(reduce(and_, (F.col(c).eqNullSafe(F.lit(v)) for c, v in equals.items()), F.lit(True)))
