"""Streaming queries over the events; each runs until the files that are there have been handled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ledger import latest_by
from millrace.plans import inputs
from millrace.plans.catalog import registered
from millrace.session import scratch_dir
from millrace.streaming import refresh
from millrace.streaming.files import follow_files

LATEST_SQL = f"""
    WITH {inputs.LEDGER_SQL}
    SELECT project_id, run_slug, task_id, arg_max(status, (ts, event_id)) AS status
    FROM ledger GROUP BY project_id, run_slug, task_id
"""
KEYS = ["project_id", "run_slug", "task_id"]
ORDER = ["ts", "event_id"]


@registered("stream_file_refresh", LATEST_SQL)
def stream_file_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads arrive one after the other; the derived table follows."""
    landing, table, checkpoint = (scratch_dir(spark, name) for name in ("landing", "current", "stream"))
    for number, load in enumerate(inputs.ledger_halves(spark, sf_dir)):
        load.write.parquet(f"{landing}/load={number}")
        stream = refresh.arriving_files(spark, f"{landing}/load=*", load.schema)
        refresh.keep_latest(stream, table, checkpoint, KEYS, ORDER, "project_id").awaitTermination()
    return spark.read.schema(load.schema).parquet(table).select(*KEYS, "status")


@registered("stream_latest_status", LATEST_SQL)
def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, path, checkpoint = inputs.ledger_stream(spark, sf_dir), scratch_dir(spark, "changes"), scratch_dir(spark, "stream")
    refresh.latest_status_changes(changes, path, checkpoint, KEYS, ORDER).awaitTermination()
    return refresh.read_latest_changes(spark, path, KEYS)


@registered(
    "stream_file_changes",
    f"""
    WITH {inputs.LEDGER_SQL},
    early AS (SELECT * FROM ledger WHERE ts < TIMESTAMP '{inputs.LEDGER_SPLIT}' AND project_id <> 'proj-2'),
    files AS (
        SELECT project_id, run_slug, task_id, ts, event_id, CASE project_id WHEN 'proj-1' THEN 'SKIPPED' ELSE status END AS status FROM early
        UNION ALL
        SELECT project_id, run_slug, task_id, ts, event_id, status FROM ledger
        WHERE ts >= TIMESTAMP '{inputs.LEDGER_SPLIT}' AND project_id IN ('proj-1', 'proj-3')
    )
    SELECT project_id, run_slug, task_id, arg_max(status, (ts, event_id)) AS status FROM files GROUP BY project_id, run_slug, task_id
    """,
)
def stream_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load has a file for each project. Then one is rewritten, one is deleted and one more arrives; the derived table follows."""
    landing, table = scratch_dir(spark, "landing"), scratch_dir(spark, "derived")
    early, late = inputs.ledger_halves(spark, sf_dir)
    early.withColumn("load", F.col("project_id")).repartition("load").write.partitionBy("load").parquet(landing)

    def refreshed():
        latest = lambda rows: latest_by(rows, KEYS, ORDER)
        return follow_files(spark, landing, table, early.schema, "project_id", lambda rows: rows, latest)

    refreshed()
    changed = early.filter("project_id = 'proj-1'").withColumn("status", F.lit("SKIPPED"))
    changed.repartition(1).write.mode("overwrite").parquet(f"{landing}/load=proj-1")
    refresh._delete(spark, f"{landing}/load=proj-2")
    late.filter("project_id IN ('proj-1', 'proj-3')").repartition(1).write.parquet(f"{landing}/load=late")
    refreshed()
    return spark.read.schema(early.schema).parquet(table).select(*KEYS, "status")
