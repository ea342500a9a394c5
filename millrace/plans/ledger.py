"""Ledger operators over the status changes derived from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ledger
from millrace.operators.lineage import reach
from millrace.plans import inputs
from millrace.plans.catalog import registered
from millrace.session import read_table

KEYS = ["project_id", "run_slug", "task_id"]
ORDER = ["ts", "event_id"]


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recorded and incoming task runs, each with the latest status per key."""
    early, late = inputs.ledger_halves(spark, sf_dir)
    return ledger.latest_status(early, KEYS, ORDER), ledger.latest_status(late, KEYS, ORDER)


@registered(
    "insert_if_absent",
    f"""
    WITH {inputs.LEDGER_SQL}
    SELECT * FROM existing
    UNION ALL SELECT * FROM incoming ANTI JOIN existing USING (project_id, run_slug, task_id)
    """,
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = halves(spark, sf_dir)
    return ledger.insert_if_absent(existing, incoming, KEYS)


@registered(
    "key_conflicts",
    f"""
    WITH {inputs.LEDGER_SQL}
    SELECT project_id, run_slug, task_id, 'taken' AS reason
    FROM incoming SEMI JOIN existing USING (project_id, run_slug, task_id)
    """,
)
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = halves(spark, sf_dir)
    return ledger.key_conflicts(existing, incoming, KEYS)


@registered(
    "soft_delete_upsert",
    """
    WITH o AS (SELECT DISTINCT 'cust-' || o_custkey AS project_id, o_orderpriority AS task_id,
                      o_orderdate < TIMESTAMP '2000-01-01' AS early FROM orders),
    e AS (SELECT project_id, task_id FROM o WHERE early), i AS (SELECT project_id, task_id FROM o WHERE NOT early)
    SELECT project_id, task_id, e.project_id NOT IN (SELECT project_id FROM i) OR (project_id, task_id) IN (SELECT project_id, task_id FROM i) AS current
    FROM e
    UNION ALL SELECT project_id, task_id, true FROM i ANTI JOIN e USING (project_id, task_id)
    """,
)
def soft_delete_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of the projects that come in are switched on or off; other projects stay as they were."""
    existing, incoming = (df.select("project_id", "task_id").distinct() for df in order_halves(spark, sf_dir))
    return ledger.soft_delete_upsert(existing, incoming, ["project_id", "task_id"])


SYNC_SQL = """
    o AS (SELECT 'cust-' || o_custkey AS project_id, o_orderpriority AS task_id, 'out/' || o_orderkey AS loc,
                 o_orderdate < TIMESTAMP '2000-01-01' AS early FROM orders),
    projects AS (SELECT 'cust-' || c_custkey AS project_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    new AS (SELECT * FROM o WHERE NOT early AND project_id IN (SELECT project_id FROM projects)),
    old AS (SELECT * FROM o WHERE early),
    new_tasks AS (SELECT DISTINCT project_id, task_id FROM new), old_tasks AS (SELECT DISTINCT project_id, task_id FROM old),
    new_refs AS (SELECT DISTINCT project_id, task_id, substr(loc, 1, 5) AS loc FROM new),
    old_refs AS (SELECT DISTINCT project_id, task_id, substr(loc, 1, 5) AS loc FROM old)
"""


@registered(
    "project_sync",
    f"""
    WITH {SYNC_SQL}
    SELECT 'task' AS kind, project_id, task_id, NULL AS loc, project_id NOT IN (SELECT project_id FROM projects)
           OR (project_id, task_id) IN (SELECT project_id, task_id FROM new_tasks) AS current
    FROM old_tasks
    UNION ALL SELECT 'task', project_id, task_id, NULL, true FROM new_tasks ANTI JOIN old_tasks USING (project_id, task_id)
    UNION ALL SELECT 'ref', project_id, task_id, loc, NULL FROM old_refs WHERE project_id NOT IN (SELECT project_id FROM projects)
    UNION ALL SELECT 'ref', project_id, task_id, loc, NULL FROM new_refs
    UNION ALL SELECT 'target', project_id, task_id, loc, NULL FROM old WHERE project_id NOT IN (SELECT project_id FROM projects)
    UNION ALL SELECT 'target', project_id, task_id, loc, NULL FROM new
    """,
)
def project_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, refs and targets after the customers of two segments were compiled again; some declare nothing any more."""
    old, late = order_halves(spark, sf_dir)
    customers = read_table(spark, sf_dir, "customer").filter("c_mktsegment in ('BUILDING', 'MACHINERY')")
    projects = customers.select(F.concat(F.lit("cust-"), F.col("c_custkey")).alias("project_id"))
    new = late.join(projects, "project_id", "left_semi")

    def tables(rows: DataFrame) -> dict[str, DataFrame]:
        refs = rows.select("project_id", "task_id", F.substring("loc", 1, 5).alias("loc")).distinct()
        return {"tasks": rows.select("project_id", "task_id").distinct(), "refs": refs, "targets": rows}

    made = ledger.sync_projects(tables(old), tables(new), projects)
    none = F.lit(None)
    tasks = made["tasks"].select(F.lit("task").alias("kind"), "project_id", "task_id", none.cast("string").alias("loc"), "current")
    rest = [
        made[name].select(F.lit(kind).alias("kind"), "project_id", "task_id", "loc", none.cast("boolean").alias("current"))
        for name, kind in (("refs", "ref"), ("targets", "target"))
    ]
    return tasks.union(rest[0]).union(rest[1])


def order_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tasks and target places per project, from the orders of each customer before and since 2000."""
    orders = read_table(spark, sf_dir, "orders")
    rows = orders.select(
        F.concat(F.lit("cust-"), F.col("o_custkey")).alias("project_id"),
        F.col("o_orderpriority").alias("task_id"),
        F.concat(F.lit("out/"), F.col("o_orderkey")).alias("loc"),
        (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")).alias("early"),
    )
    return rows.filter("early").drop("early"), rows.filter("not early").drop("early")


@registered(
    "replace_by_project",
    """
    WITH o AS (SELECT 'cust-' || o_custkey AS project_id, o_orderpriority AS task_id, 'out/' || o_orderkey AS loc,
                      o_orderdate < TIMESTAMP '2000-01-01' AS early FROM orders)
    SELECT project_id, task_id, loc FROM o WHERE early AND project_id NOT IN (SELECT project_id FROM o WHERE NOT early)
    UNION ALL SELECT project_id, task_id, loc FROM o WHERE NOT early
    """,
)
def replace_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = order_halves(spark, sf_dir)
    return ledger.replace_by_key(existing, incoming, ["project_id"])


@registered(
    "status_update",
    f"""
    WITH {inputs.LEDGER_SQL}
    SELECT project_id, run_slug, task_id, coalesce(i.status, e.status) AS status
    FROM existing e LEFT JOIN incoming i USING (project_id, run_slug, task_id)
    """,
)
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = halves(spark, sf_dir)
    return ledger.update_status(existing, incoming, KEYS)


@registered(
    "latest_status",
    f"""
    WITH {inputs.LEDGER_SQL}
    SELECT project_id, run_slug, task_id, arg_max(status, (ts, event_id)) AS status
    FROM ledger GROUP BY project_id, run_slug, task_id
    """,
)
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_status(inputs.ledger(spark, sf_dir), KEYS, ORDER)


@registered(
    "derive_status",
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR o_totalprice < 1000 THEN 'SKIPPED'
        WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status
    FROM orders
    """,
)
def derive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("o_orderstatus")
    status = ledger.derive_status(
        done=F.col("o_orderpriority") == "5-LOW",
        explicit=F.col("o_totalprice") >= 1000,
        failed=state == "F",
        finished=state == "O",
    )
    return read_table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@registered(
    "status_domain",
    f"WITH {inputs.LEDGER_SQL} SELECT event_id, status FROM ledger WHERE status = 'SKIPPED'",
)
def status_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task-run states that would be illegal for a run."""
    changes = inputs.ledger(spark, sf_dir).select("event_id", "status")
    return ledger.status_violations(changes, ledger.RUN_STATUSES)


@registered(
    "ledger_join",
    f"""
    WITH {inputs.LEDGER_SQL},
    runs AS (SELECT project_id, run_slug, min(ts) AS run_date FROM ledger GROUP BY project_id, run_slug),
    projects AS (SELECT DISTINCT project_id, '/work/' || project_id AS local_path FROM ledger),
    task_runs AS (SELECT project_id, run_slug, task_id, arg_max(status, (ts, event_id)) AS status FROM ledger GROUP BY project_id, run_slug, task_id),
    tasks AS (SELECT DISTINCT project_id, task_id, 'tasks/' || task_id AS module FROM ledger),
    refs AS (SELECT DISTINCT project_id, task_id, 'task-0' AS source_id FROM ledger WHERE task_id <> 'task-0'),
    targets AS (SELECT DISTINCT project_id, task_id, '/out/' || task_id AS loc FROM ledger),
    n AS (SELECT project_id, count(*) AS refs FROM refs JOIN projects USING (project_id) GROUP BY project_id),
    m AS (SELECT project_id, count(*) AS targets FROM targets JOIN projects USING (project_id) GROUP BY project_id),
    k AS (SELECT project_id, count(*) AS tasks FROM tasks JOIN projects USING (project_id) GROUP BY project_id)
    SELECT project_id, run_slug, task_id, status, run_date, local_path, module, refs, targets, tasks
    FROM task_runs JOIN runs USING (project_id, run_slug) JOIN projects USING (project_id) JOIN tasks USING (project_id, task_id)
         JOIN n USING (project_id) JOIN m USING (project_id) JOIN k USING (project_id)
    """,
)
def ledger_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task runs with run, project and task, and what their project has: every path between the six tables."""
    changes = inputs.ledger(spark, sf_dir)
    runs = changes.groupBy("project_id", "run_slug").agg(F.min("ts").alias("run_date"))
    projects = changes.select("project_id").distinct().withColumn("local_path", F.concat(F.lit("/work/"), "project_id"))
    task_runs = ledger.latest_status(changes, KEYS, ORDER)
    named = changes.select("project_id", "task_id").distinct()
    members = {
        "tasks": named.withColumn("module", F.concat(F.lit("tasks/"), "task_id")),
        "refs": named.filter("task_id <> 'task-0'").withColumn("source_id", F.lit("task-0")),
        "targets": named.withColumn("loc", F.concat(F.lit("/out/"), "task_id")),
    }
    placed = ledger.of_task(members["tasks"], ledger.navigate(projects, runs, task_runs), runs)
    for name, rows in members.items():
        placed = placed.join(ledger.of_project(projects, rows).groupBy("project_id").agg(F.count("*").alias(name)), "project_id")
    return placed


@registered(
    "ledger_lookup",
    f"WITH {inputs.LEDGER_SQL} SELECT event_id, ts, run_slug, task_id FROM ledger WHERE project_id = 'proj-3' AND status = 'FAILED'",
)
def ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.lookup(inputs.ledger(spark, sf_dir), project_id="proj-3", status="FAILED")
    return found.select("event_id", "ts", "run_slug", "task_id")


# An event stands for the run of the task of its number in the run of its user, whose failures are looked at.
BLOCKED_RUN = "run-1"


@registered(
    "blocked_by_failure",
    f"""
    WITH RECURSIVE {inputs.DAG_SQL}, {inputs.LEDGER_SQL},
    failed AS (SELECT event_id AS id FROM ledger WHERE run_slug = '{BLOCKED_RUN}' AND status = 'FAILED'),
    down(id) AS (SELECT id FROM failed UNION SELECT target_id FROM down JOIN dag ON source_id = id)
    SELECT id, 'NOT_RUN' AS status FROM down WHERE id NOT IN (SELECT id FROM failed)
    """,
)
def blocked_by_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that do not run because of the failed task runs of one run in the ledger."""
    changes = inputs.ledger(spark, sf_dir)
    task_runs = ledger.latest_status(changes.withColumn("task_id", F.col("event_id")), ["run_slug", "task_id"], ORDER)
    return reach.blocked_by_failure(inputs.dag_edges(spark, sf_dir), ledger.failed_tasks(task_runs, BLOCKED_RUN))
