"""Run-log operators over log lines written from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import runlog
from millrace.plans import inputs
from millrace.plans.catalog import registered
from millrace.session import read_table


@registered(
    "strip_markup",
    r"SELECT doc_id, regexp_replace(text, '\[/?[a-z]+\]', '', 'g') AS text FROM documents",
)
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup put around words of the documents comes off again, with whatever else looks like it."""
    documents = read_table(spark, sf_dir, "documents")
    marked = F.concat(F.lit("[bold]"), F.replace("text", F.lit(" "), F.lit("[/red] [blue]")), F.lit("[/bold]"))
    return documents.select("doc_id", text.strip_markup(marked).alias("text"))


@registered("strip_ansi", "SELECT doc_id, regexp_replace(text, '\x1b[^m]*m', '', 'g') AS text FROM documents")
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    coloured = F.concat(F.lit("\x1b[1;31m"), F.replace("text", F.lit(" "), F.lit("\x1b[0m \x1b[32m")), F.lit("\x1b[0m"))
    return documents.select("doc_id", text.strip_ansi(coloured).alias("text"))


LINES_SQL = f"""
    {inputs.LOG_SQL},
    named AS (SELECT *, task_id || CASE WHEN attempt > 0 THEN ' (RETRY ' || attempt || ')' ELSE '' END AS name FROM log),
    both_lines AS (
        SELECT event_id, run_slug, ts AS "at", 'RUN' AS status, position || ' of 10 RUNNING TASK ' || name AS msg, '' AS took
        FROM named
        UNION ALL
        SELECT event_id, run_slug, ts + to_microseconds(CAST(round(seconds * 1000000) AS BIGINT)), outcome,
               position || ' of 10 ' || CASE outcome WHEN 'DONE' THEN 'FINISHED' WHEN 'ERROR' THEN 'ERROR IN'
                                        ELSE 'SKIPPING' END || ' TASK ' || name,
               CASE outcome WHEN 'SKIP' THEN '' ELSE printf(' in %.2fs', seconds) END
        FROM named
    )
"""


@registered(
    "format_runlog",
    f"""
    WITH {LINES_SQL}
    SELECT event_id, run_slug, "at", strftime("at", '%H:%M:%S') || ' | ' || rpad(msg, greatest(72, length(msg))::INT, '.')
           || ' [' || status || took || ']' AS line
    FROM both_lines
    """,
)
def format_runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.format_lines(inputs.log_records(spark, sf_dir))


@registered(
    "parse_runlog",
    f"""
    WITH {inputs.LOG_SQL},
    b AS (
        SELECT event_id, ts AS "at", 'RUN' AS status, 'RUNNING' AS verb, NULL::DOUBLE AS seconds, position, task_id, attempt
        FROM log
        UNION ALL
        SELECT event_id, ts + to_microseconds(CAST(round(seconds * 1000000) AS BIGINT)), outcome,
               CASE outcome WHEN 'DONE' THEN 'FINISHED' WHEN 'ERROR' THEN 'ERROR IN' ELSE 'SKIPPING' END,
               CASE outcome WHEN 'SKIP' THEN NULL ELSE seconds END, position, task_id, attempt
        FROM log
    )
    SELECT event_id, strftime("at", '%H:%M:%S') AS clock, position, CAST(10 AS BIGINT) AS total, verb, task_id, attempt,
           status, seconds
    FROM b
    """,
)
def parse_runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the form of files and of the console, with colours and section rules among them, parsed back."""
    lines = runlog.format_lines(inputs.log_records(spark, sf_dir)).select("event_id", "line")
    console = F.concat(F.lit("["), F.substring("line", 1, 8), F.lit("] INFO     "), F.expr("substring(line, 10)"))
    form = F.when(F.col("event_id") % 2 == 0, console).otherwise(F.col("line"))
    coloured = F.regexp_replace(form, "TASK (task-[0-9]+)", "TASK [blue]$1[/blue]")
    rule = F.concat(F.lit("[dim]"), F.repeat(F.lit("─"), 40), F.lit("[/dim]"))
    noisy = lines.select("event_id", F.explode(F.array(coloured, rule)).alias("line"))
    return runlog.parse_lines(noisy).drop("line")


@registered(
    "task_durations",
    f"""
    WITH {inputs.LOG_SQL},
    lines AS (
        SELECT run_slug, task_id, attempt, ts AS "at", 'RUN' AS status FROM log
        UNION ALL
        SELECT run_slug, task_id, attempt, ts + to_microseconds(CAST(round(seconds * 1000000) AS BIGINT)), outcome FROM log
    ),
    near AS (
        SELECT *, lead(status) OVER w AS next, lead("at") OVER w AS next_at, lag(status) OVER w AS last
        FROM lines WINDOW w AS (PARTITION BY run_slug, task_id, attempt ORDER BY "at", status = 'RUN', status)
    ),
    executions AS (
        SELECT run_slug, task_id, attempt, "at" AS started, CASE WHEN next <> 'RUN' THEN next_at END AS ended,
               CASE WHEN next <> 'RUN' THEN next END AS outcome
        FROM near WHERE status = 'RUN'
        UNION ALL
        SELECT run_slug, task_id, attempt, NULL, "at", status FROM near WHERE status <> 'RUN' AND last IS DISTINCT FROM 'RUN'
    )
    SELECT *, CAST(epoch_us(ended) - epoch_us(started) AS BIGINT) AS elapsed_micros FROM executions
    """,
)
def task_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = runlog.parse_lines(runlog.format_lines(inputs.log_records(spark, sf_dir)))
    return runlog.task_durations(lines, ["run_slug", "task_id", "attempt"])


@registered("attempt_number", f"WITH {inputs.LOG_SQL} SELECT event_id, task_id, attempt FROM log")
def attempt_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = inputs.log_records(spark, sf_dir).select(
        "event_id", runlog.retry_name(F.col("task_id"), F.col("attempt")).alias("name")
    )
    return names.select("event_id", runlog.attempt_number(F.col("name")).alias("a")).select("event_id", "a.*")


@registered(
    "retry_summary",
    f"""
    WITH {inputs.LOG_SQL},
    a AS (SELECT run_slug, task_id, min(attempt) FILTER (outcome = 'DONE') AS first_success, max(attempt) AS last
          FROM log GROUP BY run_slug, task_id)
    SELECT run_slug, task_id, first_success,
           CASE WHEN first_success <= 1 THEN first_success + 1 ELSE least(last, 1) + 1 END AS attempts,
           coalesce(first_success <= 1, false) AS succeeded
    FROM a
    """,
)
def retry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.retry_summary(inputs.log_records(spark, sf_dir), ["run_slug", "task_id"], retries=1)


@registered(
    "status_label",
    f"""
    WITH {inputs.LOG_SQL}
    SELECT event_id, CASE outcome WHEN 'DONE' THEN '[green]DONE[/green]' WHEN 'ERROR' THEN '[red]ERROR[/red]'
                     ELSE '[orange1]SKIP[/orange1]' END AS label
    FROM log
    """,
)
def status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.log_records(spark, sf_dir).select("event_id", runlog.status_label(F.col("outcome")).alias("label"))
