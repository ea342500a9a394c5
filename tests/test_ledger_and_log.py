import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import ledger, runlog
from millrace.session import scratch_dir
from millrace.streaming import refresh

LEDGER = "project_id string, task_id string, status string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_insert_if_absent(spark):
    have = spark.createDataFrame([("p", "a", "FAILED")], LEDGER)
    come = spark.createDataFrame([("p", "a", "RUNNING"), ("p", "b", "PENDING"), ("p", "b", "RUNNING")], LEDGER)
    got = ledger.insert_if_absent(have, come, ["project_id", "task_id"])
    assert rows(got) == [("p", "a", "FAILED"), ("p", "b", "RUNNING")]
    assert rows(ledger.insert_if_absent(got, come, ["project_id", "task_id"])) == rows(got)


def test_unique_insert(spark):
    have = spark.createDataFrame([("p", "a", "FAILED")], LEDGER)
    keys = ["project_id", "task_id"]
    come = spark.createDataFrame([("p", "a", "RUNNING"), ("p", "b", "PENDING"), ("p", "b", "RUNNING")], LEDGER)
    assert rows(ledger.key_conflicts(have, come, keys)) == [("p", "a", "taken"), ("p", "b", "repeated")]
    with pytest.raises(ValueError, match="not unique"):
        ledger.insert_unique(have, come, keys)
    assert ledger.insert_unique(have, come.filter("status = 'PENDING'"), keys).count() == 2


def test_soft_delete(spark):
    have = spark.createDataFrame([("p", "a", True), ("p", "b", False), ("p", "c", True)], "project_id string, task_id string, current boolean")
    come = spark.createDataFrame([("p", "b"), ("p", "d"), ("p", "c")], "project_id string, task_id string")
    got = ledger.soft_delete_upsert(have, come, ["project_id", "task_id"])
    assert rows(got) == [("p", "a", False), ("p", "b", True), ("p", "c", True), ("p", "d", True)]


def test_replace_and_update(spark):
    have = spark.createDataFrame([("p", "a", "RUNNING"), ("p", "b", "RUNNING"), ("q", "a", "RUNNING")], LEDGER)
    new = spark.createDataFrame([("p", "z", "PENDING")], LEDGER)
    assert rows(ledger.replace_by_key(have, new, ["project_id"])) == [("p", "z", "PENDING"), ("q", "a", "RUNNING")]
    done = spark.createDataFrame([("p", "a", "SUCCEEDED"), ("p", "x", "FAILED")], LEDGER)
    got = ledger.update_status(have, done, ["project_id", "task_id"])
    assert rows(got) == [("p", "a", "SUCCEEDED"), ("p", "b", "RUNNING"), ("q", "a", "RUNNING")]
    assert got.columns == have.columns


def test_first_recorded_row_wins_also_with_maps_and_null_keys(spark):
    schema = "project_id string, at int, ctx map<string,string>"
    have = spark.createDataFrame([(None, 0, {"a": "1"})], schema)
    come = spark.createDataFrame([("p", 2, {"x": "late"}), ("p", 1, {"x": "first"}), (None, 5, {})], schema)
    got = ledger.insert_if_absent(have, come, ["project_id"], order_by=["at"])
    assert {(r.project_id, r.at) for r in got.collect()} == {(None, 0), ("p", 1)} and got.count() == 2
    assert ledger.insert_if_absent(got, come, ["project_id"]).count() == 2
    assert ledger.insert_if_absent(have, come, ["project_id"]).count() == 2


def test_other_projects_are_left_alone(spark):
    schema = "project_id string, task_id string, owner string, current boolean"
    have = spark.createDataFrame([("p", "a", "me", True), ("p", "b", "me", True), ("q", "b", "you", True), ("q", "c", "you", False), ("r", "d", None, True)], schema)
    come = spark.createDataFrame([("p", "a"), ("p", "n")], "project_id string, task_id string")
    covered = spark.createDataFrame([("p",), ("r",)], "project_id string")
    got = ledger.soft_delete_upsert(have, come, ["project_id", "task_id"], covered)
    assert {tuple(r) for r in got.collect()} == {
        ("p", "a", "me", True), ("p", "b", "me", False), ("p", "n", None, True), ("q", "b", "you", True), ("q", "c", "you", False), ("r", "d", None, False)
    }
    refs = spark.createDataFrame([("p", "a"), ("q", "b"), ("r", "c"), (None, "d")], "project_id string, ref string")
    nothing = refs.limit(0)
    assert rows(ledger.replace_by_key(refs, nothing, ["project_id"], covered).filter("project_id is not null")) == [("q", "b")]
    of_null = spark.createDataFrame([(None, "e")], "project_id string, ref string")
    assert rows(ledger.replace_by_key(refs, of_null, ["project_id"]).filter("project_id is null")) == [(None, "e")]
    new = ledger.sync_projects({"tasks": have, "refs": refs, "targets": refs}, {"tasks": come, "refs": nothing, "targets": nothing}, covered)
    assert new["tasks"].count() == 6 and new["refs"].count() == new["targets"].count() == 2


def test_repeated_updates(spark):
    have = spark.createDataFrame([("p", "a", "PENDING"), (None, "a", "PENDING")], LEDGER)
    twice = spark.createDataFrame([("p", "a", "RUNNING", 1), ("p", "a", "FAILED", 2), (None, "a", "SKIPPED", 1)], LEDGER + ", n int")
    got = ledger.update_status(have, twice, ["project_id", "task_id"], order_by=["n"])
    assert {tuple(r) for r in got.collect()} == {("p", "a", "FAILED"), (None, "a", "SKIPPED")} and got.count() == 2
    with pytest.raises(Exception, match="several states"):
        ledger.update_status(have, twice, ["project_id", "task_id"]).collect()
    assert ledger.update_status(have, twice.filter("n = 1"), ["project_id", "task_id"]).count() == 2


def test_status_rules(spark):
    df = spark.createDataFrame(
        [(1, True, True, False, True), (2, False, False, False, False), (3, False, True, True, False),
         (4, False, True, False, True), (5, False, True, False, False)],
        "n int, done boolean, explicit boolean, failed boolean, finished boolean",
    )
    status = ledger.derive_status(*(F.col(c) for c in ("done", "explicit", "failed", "finished")))
    got = [r.s for r in df.orderBy("n").select(status.alias("s")).collect()]
    assert got == ["SKIPPED", "SKIPPED", "FAILED", "SUCCEEDED", "RUNNING"]
    odd = spark.createDataFrame([("RUNNING",), ("running",), (None,), ("SKIPPED",)], "status string")
    assert ledger.status_violations(odd).count() == 2
    assert ledger.status_violations(odd, ledger.RUN_STATUSES).count() == 3


def test_navigation_with_a_hot_run(spark):
    projects = spark.createDataFrame([("p", "/x"), ("q", "/y")], "project_id string, local_path string")
    runs = spark.createDataFrame([("r1", "p"), ("r2", "q")], "run_slug string, project_id string")
    many = spark.range(300).select(
        F.when(F.col("id") < 200, "r1").otherwise("r2").alias("run_slug"), F.col("id").cast("string").alias("task_id")
    )
    got = ledger.navigate(projects, runs, many)
    assert got.count() == 300 and got.filter("local_path = '/x'").count() == 200
    assert ledger.lookup(got, run_slug="r2", local_path="/y").count() == 100
    assert ledger.lookup(got).count() == 300


LOG = """\
12:00:01 | ─────────────── ignored, it is no rule
────────────────────────────────
12:00:02 | 1 of 2 RUNNING TASK load.load................................................. [RUN]
12:00:03 | 1 of 2 [red]ERROR[/red] IN TASK [blue]load.load[/blue]........................ [\x1b[31mERROR\x1b[0m in 0.02s]
12:00:04 | 1 of 2 RUNNING TASK load.load (RETRY 1)....................................... [RUN]
12:00:05 | 1 of 2 FINISHED TASK load.load (RETRY 1) (RETRY 2)............................ [DONE in 12.50s]
12:00:06 | [orange1]SKIPPING[/orange1] TASK task01.Task01................ [[orange1]SKIP[orange1]]
12:00:07 | FINISHED parsing task dependencies...................................... [DONE in 0.01s]
"""


def test_parsing_a_log(spark):
    lines = spark.createDataFrame(list(enumerate(LOG.splitlines())), "n int, line string")
    got = {r.n: tuple(r)[2:] for r in runlog.parse_lines(lines).collect()}
    assert got[0] == (None,) * 8 and got[7] == (None,) * 8 and 1 not in got
    assert got[2] == ("12:00:02", 1, 2, "RUNNING", "load.load", 0, "RUN", None)
    assert got[3] == ("12:00:03", 1, 2, "ERROR IN", "load.load", 0, "ERROR", 0.02)
    assert got[4] == ("12:00:04", 1, 2, "RUNNING", "load.load", 1, "RUN", None)
    assert got[5] == ("12:00:05", 1, 2, "FINISHED", "load.load", 2, "DONE", 12.5)
    assert got[6] == ("12:00:06", None, None, "SKIPPING", "task01.Task01", 0, "SKIP", None)


def test_line_layout(spark):
    df = spark.createDataFrame([("t",), ("x" * 90,)], "task string").withColumn("at", F.lit("2024-01-01 23:59:58").cast("timestamp"))
    line = runlog.log_line(F.col("at"), F.lit(1), F.lit(2), F.col("task"), F.lit(0), F.lit("DONE"), F.lit(0.019))
    short, long = (r.line for r in df.select(line.alias("line")).collect())
    assert short == "23:59:58 | " + "1 of 2 FINISHED TASK t".ljust(72, ".") + " [DONE in 0.02s]"
    assert long == "23:59:58 | 1 of 2 FINISHED TASK " + "x" * 90 + " [DONE in 0.02s]"


def test_labels(spark):
    df = spark.createDataFrame([("DONE",), ("ERROR",), ("RUN",), ("SKIP",)], "s string")
    got = [r.x for r in df.select(runlog.status_label(F.col("s")).alias("x")).collect()]
    assert got == ["[green]DONE[/green]", "[red]ERROR[/red]", "[yellow]RUN[/yellow]", "[orange1]SKIP[/orange1]"]
    with pytest.raises(Exception, match="not a log status: LOST"):
        df.select(runlog.status_label(F.lit("LOST"))).collect()


def test_attempts_and_retries(spark):
    names = spark.createDataFrame([("a",), ("a (RETRY 1)",), ("a (RETRY 1) (RETRY 2) ",)], "n string")
    got = [tuple(r.a) for r in names.select(runlog.attempt_number(F.col("n")).alias("a")).collect()]
    assert got == [("a", 0), ("a", 1), ("a", 2)]
    runs = spark.createDataFrame(
        [("ok", 0, "DONE"), ("ok", 1, "ERROR"), ("late", 0, "ERROR"), ("late", 1, "DONE"),
         ("bad", 0, "ERROR"), ("bad", 1, "ERROR"), ("bad", 2, "ERROR")], "t string, attempt int, outcome string",
    )
    got = {r.t: (r.attempts, r.succeeded) for r in runlog.retry_summary(runs, ["t"], retries=1).collect()}
    assert got == {"ok": (1, True), "late": (2, True), "bad": (2, False)}


def test_durations_of_open_executions(spark):
    lines = spark.sql(
        "SELECT * FROM VALUES ('a', 'RUN', TIMESTAMP '2024-01-01 23:59:59'), ('a', 'DONE', TIMESTAMP '2024-01-02 00:00:01.5'),"
        " ('b', 'RUN', TIMESTAMP '2024-01-01 00:00:00') AS t(k, status, at)"
    )
    got = {r.k: (r.outcome, r.elapsed_micros) for r in runlog.task_durations(lines, ["k"]).collect()}
    assert got == {"a": ("DONE", 2_500_000), "b": (None, None)}


def test_repeated_executions_stay_apart(spark):
    lines = spark.sql(
        "SELECT * FROM VALUES ('a', 'RUN', TIMESTAMP '2024-01-01 10:00:00'), ('a', 'ERROR', TIMESTAMP '2024-01-01 10:00:05'),"
        " ('a', 'RUN', TIMESTAMP '2024-01-01 12:00:00'), ('a', 'DONE', TIMESTAMP '2024-01-01 12:00:01'),"
        " ('a', 'RUN', TIMESTAMP '2024-01-01 12:00:01'), ('b', 'SKIP', TIMESTAMP '2024-01-01 10:00:00') AS t(k, status, at)"
    )
    got = sorted((r.k, r.outcome or "", r.elapsed_micros or 0) for r in runlog.task_durations(lines, ["k"]).collect())
    assert got == [("a", "", 0), ("a", "DONE", 1_000_000), ("a", "ERROR", 5_000_000), ("b", "SKIP", 0)]


def test_console_lines_and_markup(spark):
    lines = [
        "[12:00:02] INFO     | 1 of 2 RUNNING TASK load.load................................................. [RUN]",
        "[12:00:03] ERROR    | 1 of 2 ERROR IN TASK load.load........................ [ERROR in 0.02s]",
        "[12:00:04] INFO     | RUNNING TASK x.................. [RUN]",
    ]
    got = [tuple(r)[1:] for r in runlog.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [
        ("12:00:02", 1, 2, "RUNNING", "load.load", 0, "RUN", None), ("12:00:03", 1, 2, "ERROR IN", "load.load", 0, "ERROR", 0.02),
        ("12:00:04", None, None, "RUNNING", "x", 0, "RUN", None),
    ]
    at = F.lit("2024-01-01 23:59:58").cast("timestamp")
    names = spark.createDataFrame([("[blue]t[/blue]",), ("\x1b[1;31mt\x1b[0m",)], "task string")
    line = runlog.log_line(at, F.lit(None).cast("bigint"), F.lit(2), F.col("task"), F.lit(0), F.lit("RUN"), F.lit(None).cast("double"))
    for r in names.select("task", line.alias("line")).collect():
        assert r.line == f"23:59:58 | RUNNING TASK {r.task}" + "." * (72 - len("RUNNING TASK t")) + " [RUN]"


def test_cleaning(spark):
    df = spark.createDataFrame([("[bold]a[/bold] [x1] [B] \x1b[1;31mred\x1b[0m",)], "s string")
    row = df.select(text.strip_markup(F.col("s")).alias("m"), text.strip_ansi(F.col("s")).alias("a")).first()
    assert row.m == "a [x1] [B] \x1b[1;31mred\x1b[0m" and row.a == "[bold]a[/bold] [x1] [B] red"


def test_stream_keeps_up_with_arriving_files(spark):
    landing, table, checkpoint = (scratch_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "k string, p string, n int, status string"
    loads = [
        [("a", "x", 1, "RUNNING"), ("b", "x", 1, "RUNNING"), ("c", "y", 1, "RUNNING")],
        [("a", "x", 2, "FAILED"), ("d", "z", 1, "PENDING")],
        [],
        [("a", "x", 0, "late"), ("c", "y", 5, "SUCCEEDED")],
    ]
    for i, load in enumerate(loads):
        spark.createDataFrame(load, schema).coalesce(1).write.parquet(f"{landing}/load={i}")
        stream = refresh.arriving_files(spark, f"{landing}/load=*", schema)
        refresh.keep_latest(stream, table, checkpoint, ["k"], ["n"], "p").awaitTermination()
    got = spark.read.schema(schema).parquet(table).select("k", "n", "status")
    assert rows(got) == [("a", 2, "FAILED"), ("b", 1, "RUNNING"), ("c", 5, "SUCCEEDED"), ("d", 1, "PENDING")]


def test_stream_state_over_several_batches(spark):
    landing, changes, checkpoint = (scratch_dir(spark, n) for n in ("in", "out", "ck"))
    schema = "k string, n int, status string"
    for i, load in enumerate([[("a", 1, "RUNNING"), ("b", 1, "RUNNING")], [("a", 2, "FAILED"), ("b", 0, "late")]]):
        spark.createDataFrame(load, schema).coalesce(1).write.parquet(f"{landing}/load={i}")
        stream = refresh.arriving_files(spark, f"{landing}/load=*", schema)
        refresh.latest_status_changes(stream, changes, checkpoint, ["k"], ["n"]).awaitTermination()
    assert rows(refresh.read_latest_changes(spark, changes, ["k"])) == [("a", "FAILED"), ("b", "RUNNING")]
