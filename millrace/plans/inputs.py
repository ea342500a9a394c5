"""Graphs, task sources, ledgers and run logs derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import read_table

# -- a dependency graph over the parts: an acyclic one, and the same with some edges back ----------

DAG_SQL = """
    dag AS (
        SELECT DISTINCT source_id, target_id FROM (
            SELECT p_partkey // 2 AS source_id, p_partkey AS target_id FROM part
            UNION ALL
            SELECT p_partkey // 3 AS source_id, p_partkey AS target_id FROM part
        ) WHERE source_id <> target_id
    )
"""

CYCLIC_SQL = (
    DAG_SQL
    + """,
    cyclic AS (
        SELECT source_id, target_id FROM dag
        UNION
        SELECT p_partkey AS source_id, p_partkey // 4 AS target_id FROM part WHERE p_size = 50
    )
"""
)

SEEDS_SQL = "seeds AS (SELECT p_partkey AS id FROM part WHERE p_size = 50 AND p_type = 'SMALL')"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"))


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part needs the parts at half and at a third of its key. Sources are the smaller key."""
    sources = F.array_distinct(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3")))
    edges = parts(spark, sf_dir).select(F.explode(sources).alias("source_id"), F.col("p_partkey").alias("target_id"))
    # A part occurs once in its table, so these pairs are distinct as they are.
    return edges.filter("source_id <> target_id")


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = parts(spark, sf_dir).filter("p_size = 50").selectExpr("p_partkey AS source_id", "p_partkey div 4 AS target_id")
    return dag_edges(spark, sf_dir).union(back).distinct()


def seed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).filter("p_size = 50 AND p_type = 'SMALL'").select(F.col("p_partkey").alias("id"))


# -- task declarations and sources: one task per part -------------------------------------------

TASKS_SQL = """
    tasks AS (
        SELECT 'task-' || p_partkey AS id,
               'parts/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '.py' AS path
        FROM part
    )
"""


def task_name(key: str):
    return F.concat(F.lit("task-"), F.expr(key).cast("string"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, path)``: a module per type and brand holds the tasks of its parts."""
    path = F.concat(
        F.lit("parts/"), F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit(".py")
    )
    return parts(spark, sf_dir).select(task_name("p_partkey").alias("id"), path.alias("path"))


def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = dag_edges(spark, sf_dir)
    return edges.select(task_name("source_id").alias("source_id"), task_name("target_id").alias("target_id"))


def task_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, text)``: the source of each task, which refers to its inputs in both call forms."""
    half, third = task_name("p_partkey div 2"), task_name("p_partkey div 3")
    by_position = F.concat(F.lit('    first = CurrentRun.ref("'), half, F.lit('")\n'))
    by_keyword = F.concat(F.lit("    second = runtime.CurrentRun.ref(task_id='"), third, F.lit("')\n"))
    text = F.concat(
        F.lit("def run(self):\n    # CurrentRun.ref(\"not-a-reference\")\n"),
        F.when(F.expr("p_partkey div 2 <> p_partkey"), by_position).otherwise(""),
        F.when(F.expr("p_partkey div 3 <> p_partkey div 2"), by_keyword).otherwise(""),
        F.lit("    return 1\n"),
    )
    return parts(spark, sf_dir).select(task_name("p_partkey").alias("id"), text.alias("text"))


# -- a ledger from the events -----------------------------------------------------------------

# How the types of events are read as states of a task run.
EVENT_STATUS = {
    "signup": "PENDING", "view": "RUNNING", "purchase": "SUCCEEDED", "error": "FAILED", "click": "SKIPPED",
}

LEDGER_SQL = """
    ledger AS (
        SELECT event_id, ts, 'proj-' || (user_id % 10) AS project_id, 'run-' || user_id AS run_slug,
               'task-' || (event_id % 7) AS task_id,
               CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING'
                    WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'SKIPPED' END AS status
        FROM events
    ),
    latest AS (
        SELECT project_id, run_slug, task_id, arg_max(status, (ts, event_id)) AS status, ts < TIMESTAMP '2024-01-16' AS old
        FROM ledger GROUP BY project_id, run_slug, task_id, ts < TIMESTAMP '2024-01-16'
    ),
    existing AS (SELECT project_id, run_slug, task_id, status FROM latest WHERE old),
    incoming AS (SELECT project_id, run_slug, task_id, status FROM latest WHERE NOT old)
"""

LEDGER_SPLIT = "2024-01-16"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes: ``(event_id, ts, project_id, run_slug, task_id, status)``."""
    return status_changes(read_table(spark, sf_dir, "events"))


def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes as a stream over the event files."""
    schema = read_table(spark, sf_dir, "events").schema
    return status_changes(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def status_changes(events: DataFrame) -> DataFrame:
    status = F.lit(None).cast("string")
    for event_type, name in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == event_type, name).otherwise(status)
    return events.select(
        "event_id",
        "ts",
        F.concat(F.lit("proj-"), F.col("user_id") % 10).alias("project_id"),
        F.concat(F.lit("run-"), F.col("user_id")).alias("run_slug"),
        F.concat(F.lit("task-"), F.col("event_id") % 7).alias("task_id"),
        status.alias("status"),
    )


def ledger_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Status changes before and from the middle of the month: what is recorded and what comes in."""
    changes = ledger(spark, sf_dir)
    early = F.col("ts") < F.lit(LEDGER_SPLIT).cast("timestamp_ntz")
    return changes.filter(early), changes.filter(~early)


# -- a run log from the events ----------------------------------------------------------------

LOG_SQL = """
    log AS (
        SELECT event_id, ts, 'run-' || user_id AS run_slug, 'task-' || (event_id % 7) AS task_id,
               event_id % 3 AS attempt, event_id % 10 + 1 AS position, value AS seconds, event_type,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'SKIP' ELSE 'DONE' END AS outcome
        FROM events
    )
"""


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task execution per event, before it is written as log lines."""
    outcome = (
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "SKIP").otherwise("DONE")
    )
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.concat(F.lit("run-"), F.col("user_id")).alias("run_slug"),
        F.concat(F.lit("task-"), F.col("event_id") % 7).alias("task_id"),
        (F.col("event_id") % 3).alias("attempt"),
        (F.col("event_id") % 10 + 1).alias("position"),
        F.lit(10).cast("bigint").alias("total"),
        F.col("value").alias("seconds"),
        outcome.alias("outcome"),
    )
