"""Tables that follow streams and files, also when a run breaks off."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.ledger import insert_unique, key_conflicts, latest_by
from millrace.streaming import files, refresh

SCHEMA = "k string, n int, status string"


def stop_at(monkeypatch, number):
    """Make the sink break off at its ``number``-th step that touches files; returns the count of steps so far."""
    count, drop, changes = [0], refresh._delete, refresh._changes

    def step(f):
        def stepped(*args, **kw):
            count[0] += 1
            if count[0] == number:
                raise RuntimeError("lost")
            return f(*args, **kw)
        return stepped

    monkeypatch.setattr(refresh, "_delete", step(drop))
    monkeypatch.setattr(refresh, "_changes", step(changes))
    monkeypatch.setattr(refresh, "_drop_folded", step(refresh._drop_folded))
    monkeypatch.setattr(refresh, "latest_by", step(latest_by))
    return count


@pytest.mark.parametrize("broken_at", [1, 2, 3, 4, 5])
def test_a_compacting_batch_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch, broken_at):
    monkeypatch.setattr(refresh, "COMPACT_EVERY", 2)
    landing, changes, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def run(i):
        spark.createDataFrame([("a", i, f"s{i}"), (f"k{i}", i, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{landing}/load={i}")
        stream = refresh.arriving_files(spark, f"{landing}/load=*", SCHEMA)
        refresh.latest_status_changes(stream, changes, checkpoint, ["k"], ["n"]).awaitTermination()

    for i in range(4):
        run(i)
    with monkeypatch.context() as m:
        count = stop_at(m, broken_at)
        try:
            run(4)  # folds 0 to 3
            assert count[0] < broken_at
        except Exception as error:
            assert "lost" in str(error)
    for i in (5, 6):
        run(i)
    got = {r.k: r.status for r in refresh.read_latest_changes(spark, changes, ["k"]).collect()}
    assert got == {"a": "s6", **{f"k{i}": "x" for i in range(7)}}
    kept = sorted(p.name for p in (tmp_path / "out").iterdir() if "=" in p.name)
    assert len([n for n in kept if n.startswith("_upto=")]) <= 2 and "batch_id=0" not in kept


def test_an_upsert_opens_only_the_partitions_it_touches(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.createDataFrame([(i, f"p{i % 4}") for i in range(40)] + [(99, None)], "n int, p string").write.partitionBy("p").parquet(table)
    whole = spark.read.schema("n int, p string").parquet(table)
    some = refresh.in_partitions(whole, "p", spark.createDataFrame([("p1",), (None,), ("p1",)], "p string"))
    assert sorted(r.n for r in some.collect()) == [*range(1, 40, 4), 99]
    assert some.select(F.input_file_name()).distinct().count() <= whole.filter("p = 'p1' OR p IS NULL").select(F.input_file_name()).distinct().count()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "p1" in plan.split("PartitionFilters")[1].split("]")[0], plan


def follow(spark, root, table):
    schema = spark.createDataFrame([], "p string, n int, w string").schema
    build = lambda rows: rows.groupBy("p").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    return files.follow_files(spark, root, table, schema, "p", lambda rows: rows.filter("n >= 0"), build)


def load(spark, root, name, rows):
    spark.createDataFrame(rows, "p string, n int, w string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")


def totals(spark, table):
    return {r.p: (r.total, r.rows) for r in spark.read.schema("p string, total long, rows long").parquet(table).collect()}


def test_a_table_follows_its_files(spark, tmp_path):
    root, table = str(tmp_path / "in"), str(tmp_path / "out")
    load(spark, root, "a", [("x", 1, ""), ("y", 2, ""), ("x/1", 5, ""), (None, 7, "")])
    load(spark, root, "b", [("y", 3, ""), ("z", 4, ""), ("z", -1, "")])
    assert follow(spark, root, table) == files.Refresh(2, 0, 0, 5)
    assert totals(spark, table) == {"x": (1, 1), "y": (5, 2), "x/1": (5, 1), None: (7, 1), "z": (4, 1)}
    assert follow(spark, root, table) == files.Refresh(0, 0, 0, 0)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("p=x/*.parquet")}

    load(spark, root, "b", [("y", 30, "")])  # rewritten under another name: one goes, one comes
    done = follow(spark, root, table)
    assert (done.added, done.removed, done.partitions) == (1, 1, 2)
    assert totals(spark, table) == {"x": (1, 1), "y": (32, 2), "x/1": (5, 1), None: (7, 1)}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("p=x/*.parquet")} == stamps  # left alone

    for part in (tmp_path / "in" / "a").glob("*.parquet"):  # moved, and nothing else
        os.rename(part, tmp_path / "in" / "b" / part.name)
    done = follow(spark, root, table)
    assert (done.added, done.removed, done.partitions) == (1, 1, 4)
    assert totals(spark, table) == {"x": (1, 1), "y": (32, 2), "x/1": (5, 1), None: (7, 1)}

    part = next((tmp_path / "in" / "b").glob("*.parquet"))
    others = [p for p in (tmp_path / "in" / "b").glob("*.parquet") if p != part]
    os.utime(part, ns=(1, 1))  # the same content at another time
    assert follow(spark, root, table).changed == 1
    for p in [part, *others]:
        p.unlink()
    assert follow(spark, root, table).removed == 2
    assert totals(spark, table) == {}


def test_a_refresh_that_breaks_off_is_made_up_for(spark, tmp_path, monkeypatch):
    root, table = str(tmp_path / "in"), str(tmp_path / "out")
    load(spark, root, "a", [("x", 1, ""), ("y", 2, "")])
    follow(spark, root, table)
    load(spark, root, "b", [("z", 9, "")])
    with monkeypatch.context() as m:
        m.setattr(files, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            follow(spark, root, table)
    for part in (tmp_path / "in" / "b").glob("*.parquet"):  # what the broken attempt published is gone again
        part.unlink()
    follow(spark, root, table)
    assert totals(spark, table) == {"x": (1, 1), "y": (2, 1)}


def test_null_keys_are_not_unique_twice(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n int")
    new = spark.createDataFrame([(None, 5), ("b", 6)], "k string, n int")
    assert [tuple(r) for r in key_conflicts(rows, new, ["k"]).collect()] == [(None, "taken")]
    with pytest.raises(ValueError):
        insert_unique(rows, new, ["k"])
