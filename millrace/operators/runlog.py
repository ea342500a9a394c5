"""Run logs: from records to lines, from lines to records, and what the records say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import is_rule_line, strip_ansi, strip_markup
from millrace.operators.scan import scan
from millrace.session import stored

# The layout of a log line.
TEXT_WIDTH = 72  # nine tenths of a line of 80
STATUS_LABELS = {
    "RUN": "[yellow]RUN[/yellow]",
    "DONE": "[green]DONE[/green]",
    "ERROR": "[red]ERROR[/red]",
    "SKIP": "[orange1]SKIP[/orange1]",
}
VERBS = {"RUN": "RUNNING", "DONE": "FINISHED", "ERROR": "ERROR IN", "SKIP": "SKIPPING"}
COLOURS = "\x1b[^m]*m|\\[/?[a-z]+\\d*\\]"
LINE_PATTERN = (
    r"^\[?(\d{2}:\d{2}:\d{2})\]? (?:[A-Z]+ +)?\| (?:(\d+) of (\d+) )?(RUNNING|FINISHED|ERROR IN|SKIPPING) TASK (.*?)"
    r"(?: \(RETRY \d+\))*?(?: \(RETRY (\d+)\))?\.* \[(RUN|DONE|ERROR|SKIP)(?: in (\d+\.\d+)s)?\]$"
)
LINE_FIELDS = ("clock", "position", "total", "verb", "task_id", "attempt", "status", "seconds")
_SEPARATOR = "\x1f"


def _by_status(status: Column, values: dict[str, str]) -> Column:
    bad = F.raise_error(F.concat(F.lit("not a log status: "), F.coalesce(status, F.lit("NULL")))).cast("string")
    result = bad
    for name, value in values.items():
        result = F.when(status == name, value).otherwise(result)
    return result


def status_label(status: Column) -> Column:
    """Coloured label of a status; any other text fails the job."""
    return _by_status(status, STATUS_LABELS)


def retry_name(task: Column, attempt: Column) -> Column:
    return F.concat(task, F.when(attempt > 0, F.concat(F.lit(" (RETRY "), attempt, F.lit(")"))).otherwise(""))


def log_line(
    clock: Column, position: Column, total: Column, task: Column, attempt: Column, status: Column, seconds: Column
) -> Column:
    """One log line, padded with dots; a longer text is not cut. RUN and SKIP show no seconds.

    Without a position or total the line has no "i of N". Colours in the task's name have no width.
    """
    number = F.coalesce(F.concat(position, F.lit(" of "), total, F.lit(" ")), F.lit(""))
    text = F.concat(number, _by_status(status, VERBS), F.lit(" TASK "), retry_name(task, attempt))
    shown = F.length(strip_markup(strip_ansi(text)))
    dots = F.repeat(F.lit("."), F.greatest(F.lit(0), F.lit(TEXT_WIDTH) - shown))
    took = F.when(status.isin("DONE", "ERROR"), F.format_string(" in %.2fs", seconds)).otherwise("")
    return F.concat(F.date_format(clock, "HH:mm:ss"), F.lit(" | "), text, dots, F.lit(" ["), status, took, F.lit("]"))


def format_lines(records: DataFrame) -> DataFrame:
    """Start and end line of each execution: ``(event_id, run_slug, at, line)``.

    ``records`` has ``event_id, ts, run_slug, task_id, attempt, position, total, seconds, outcome``.
    """
    end = F.col("ts") + F.make_dt_interval(secs=F.col("seconds").cast("decimal(18,6)"))

    def line(at: Column, status: Column) -> Column:
        fields = (F.col(c) for c in ("position", "total", "task_id", "attempt"))
        return F.struct(at.alias("at"), log_line(at, *fields, status, F.col("seconds")).alias("line"))

    both = F.array(line(F.col("ts"), F.lit("RUN")), line(end, F.col("outcome")))
    return records.select("event_id", "run_slug", F.inline(both))


def parse_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Add the typed fields of each log line; colours are removed and section rules are dropped.

    Lines of another form keep their text, with NULL fields. The generator keeps the optimizer from
    copying the pattern into each field and into later filters, so it runs once per line.
    """
    clean = F.regexp_replace(line, COLOURS, "")
    groups = _SEPARATOR.join(f"${i + 1}" for i in range(len(LINE_FIELDS)))
    kept = df.select("*", F.explode(F.array(clean)).alias("_clean")).filter(~is_rule_line(F.col("_clean")))
    fields = F.split(F.regexp_replace("_clean", LINE_PATTERN, groups), _SEPARATOR)
    cut = kept.select("*", F.explode(F.array(fields)).alias("_fields"))
    is_line = F.size("_fields") == len(LINE_FIELDS)
    field = {
        name: F.when(is_line, F.nullif(F.col("_fields")[i], F.lit(""))) for i, name in enumerate(LINE_FIELDS)
    }
    return cut.select(
        *df.columns,
        field["clock"].alias("clock"),
        field["position"].cast("bigint").alias("position"),
        field["total"].cast("bigint").alias("total"),
        field["verb"].alias("verb"),
        field["task_id"].alias("task_id"),
        F.when(is_line, F.coalesce(field["attempt"].cast("bigint"), F.lit(0))).alias("attempt"),
        field["status"].alias("status"),
        field["seconds"].cast("double").alias("seconds"),
    )


def attempt_number(name: Column) -> Column:
    """``struct(task_id, attempt)`` of a task name with or without retry suffixes."""
    last = F.regexp_extract(name, r"\(RETRY (\d+)\)\s*$", 1)
    return F.struct(
        F.regexp_replace(name, r" \(RETRY.*$", "").alias("task_id"),
        F.coalesce(F.nullif(last, F.lit("")).cast("bigint"), F.lit(0)).alias("attempt"),
    )


def task_durations(lines: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """Start, end and elapsed time of each execution, from parsed lines; ``keys`` are what the lines tell of a task.

    A key may be executed several times: in the order of time within a key, a start ends with the line that
    follows it, if that is an end. An execution without one has NULL end, outcome and elapsed time; an end without a start, as a
    skipped task has, has a NULL start. At one time, ends go first. Lines are scanned in range partitions, so a
    key may have any number of them, and each line is shuffled once. They are stored first: a range shuffle reads its input
    twice, once for the bounds of the ranges, and lines should be parsed once.
    """
    used = lines.filter(F.col("status").isNotNull()).select(*keys, F.col(at).alias("_at"), "status", (F.col("status") == "RUN").alias("_starts"))
    used = stored(used)
    near = scan(used, ["_at", "_starts", "status"], keys, lead={"_next": "status", "_next_at": "_at"}, lag={"_last": "status"})
    near = near.filter(F.col("_starts") | ~F.col("_last").eqNullSafe("RUN"))
    ended = F.when(~F.col("_starts"), F.col("_at")).when(F.col("_next") != "RUN", F.col("_next_at"))
    outcome = F.when(~F.col("_starts"), F.col("status")).when(F.col("_next") != "RUN", F.col("_next"))
    found = near.select(*keys, F.when(F.col("_starts"), F.col("_at")).alias("started"), ended.alias("ended"), outcome.alias("outcome"))
    return found.withColumn("elapsed_micros", F.timestamp_diff("MICROSECOND", "started", "ended"))


def retry_summary(executions: DataFrame, keys: Sequence[str], retries: int) -> DataFrame:
    """Attempts used per task: up to its first success, else all it was allowed.

    ``executions`` has ``attempt``, counted from 0, and ``outcome``.
    """
    agg = executions.groupBy(*keys).agg(
        F.min(F.when(F.col("outcome") == "DONE", F.col("attempt"))).alias("first_success"),
        F.max("attempt").alias("_last"),
    )
    allowed = F.least(F.col("_last"), F.lit(retries)) + 1
    succeeded = F.col("first_success").isNotNull() & (F.col("first_success") <= retries)
    return agg.select(
        *keys,
        "first_success",
        F.when(succeeded, F.col("first_success") + 1).otherwise(allowed).cast("bigint").alias("attempts"),
        succeeded.alias("succeeded"),
    )
