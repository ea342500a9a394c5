"""Formats of a user's own as targets: overwritten, appended to, reopened, and skipped over by filters."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.operators import materialize as m
from millrace.plans import storage
from millrace.session import scratch_dir
from millrace.sinks.files import write
from millrace.sources import custom
from millrace.sources.custom import register_format

SCHEMA = "id bigint, name string, x double"


def rows(spark, low, high):
    return spark.range(low, high).selectExpr("id", "concat('n', lpad(id, 6, '0')) AS name", "CAST(id AS double) / 2 AS x")


@pytest.fixture
def fmt(spark):
    register_format(spark, "arrow_own", SCHEMA, storage.open_feather, storage.save_feather, storage.count_feather_batches, ".arrow")
    return "arrow_own"


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_saved_reopened_and_refreshed(spark, fmt):
    path, calls = scratch_dir(spark, "own"), []

    def compute():
        calls.append(1)
        return rows(spark, 0, 10 * len(calls))

    for want in (10, 10):
        assert ids(m.read_or_compute(spark, path, compute, fmt)) == list(range(want))
    assert len(calls) == 1
    held = spark.read.format(fmt).load(path)
    assert ids(m.read_or_compute(spark, path, compute, fmt, full_refresh=True)) == list(range(20))
    assert ids(held) == list(range(20))
    own = m.read_or_compute(spark, path, lambda: held.filter("id < 5"), fmt, full_refresh=True)  # from its own content
    assert ids(own) == list(range(5)) and own.schema == held.schema


def test_modes_and_many_targets(spark, fmt):
    path = scratch_dir(spark, "own")
    write(rows(spark, 0, 3), path, fmt)
    with pytest.raises(ValueError, match="exists"):
        write(rows(spark, 0, 3), path, fmt)
    write(rows(spark, 9, 12), path, fmt, mode="ignore")
    write(rows(spark, 3, 5), path, fmt, mode="append")
    assert ids(spark.read.format(fmt).load(path)) == [0, 1, 2, 3, 4]
    one, two = m.materialize_many([rows(spark, 0, 2), rows(spark, 2, 4)], [(scratch_dir(spark, "a"), fmt), (scratch_dir(spark, "b"), "csv")])
    assert ids(one) == [0, 1] and ids(two) == [2, 3]
    with pytest.raises(ValueError, match="unknown format"):
        write(rows(spark, 0, 3), scratch_dir(spark, "own"), "never_registered")


def test_a_failed_overwrite_leaves_the_old_state(spark, fmt):
    path = scratch_dir(spark, "own")
    write(rows(spark, 0, 5), path, fmt)
    bad = rows(spark, 0, 50).selectExpr("id", "name", "IF(id = 40, raise_error('lost'), x) AS x")
    with pytest.raises(Exception, match="lost"):
        write(bad, path, fmt, mode="overwrite")
    assert ids(spark.read.format(fmt).load(path)) == list(range(5))


def test_old_states_go_one_overwrite_later(spark, fmt, tmp_path):
    path = str(tmp_path / "own")
    for n in (1, 2, 3, 4):
        write(rows(spark, 0, n), path, fmt, mode="overwrite")
    assert len(list((tmp_path / "own").glob("job=*"))) == 2
    assert sorted(p.name for p in (tmp_path / "own" / "_published").glob("*.json")) == ["2.json", "3.json"]
    assert ids(spark.read.format(fmt).load(path)) == [0, 1, 2, 3]


def test_filters_skip_files_by_their_ranges(spark, fmt):
    path = scratch_dir(spark, "own")
    write(rows(spark, 0, 8000).repartitionByRange(8, "id"), path, fmt)
    whole = spark.read.format(fmt).load(path)
    assert whole.rdd.getNumPartitions() == 8
    for condition, parts in (("id = 77", 1), ("id > 6500", 2), ("name = 'n000077'", 1), ("id IN (3, 7900)", 2), ("x < 100 AND id >= 10", 1), ("id = -1", 0), ("x = 3.5", 1)):
        some = whole.filter(condition)
        assert some.rdd.getNumPartitions() <= max(parts, 1), condition
        assert ids(some) == ids(rows(spark, 0, 8000).filter(condition)), condition


def test_values_without_an_order_skip_nothing(spark, fmt):
    path = scratch_dir(spark, "own")
    odd = spark.sql("SELECT 1L AS id, CAST(NULL AS string) AS name, CAST('NaN' AS double) AS x UNION ALL SELECT 2L, 'b', 1.0D UNION ALL SELECT 3L, NULL, NULL")
    write(odd.coalesce(1), path, fmt)
    back = spark.read.format(fmt).load(path)
    assert ids(back.filter("x > 5")) == [1] and ids(back.filter("name = 'b'")) == [2] and ids(back.filter("name IS NULL")) == [1, 3]
    write(odd.filter("id <> 2").coalesce(1), path, fmt, mode="overwrite")
    assert ids(spark.read.format(fmt).load(path).filter("name = 'b'")) == []


def test_pieces_are_skipped_by_the_formats_own_statistics(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def may_hold(stream, piece, filters):
        import pyarrow.parquet as pq

        group = pq.ParquetFile(stream).metadata.row_group(piece)
        found = group.column(0).statistics
        return all(column != "id" or op != "=" or found.min <= value <= found.max for column, op, value in filters)

    def open_noting(stream, piece):
        with open(seen, "a") as note:
            note.write(f"{piece}\n")
        yield from storage.open_parquet(stream, piece)

    pq.write_table(pa.table({"id": pa.array(range(100))}), tmp_path / "one.pq", row_group_size=10)
    register_format(spark, "own_pieces", "id bigint", open_noting, count_pieces=storage.count_row_groups, suffix=".pq", may_hold=may_hold)
    df = spark.read.format("own_pieces").load(str(tmp_path))
    assert ids(df.filter("id = 42")) == [42]
    with open(seen) as note:
        assert note.read().split() == ["4"]


def test_many_unknown_files_are_counted_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(custom, "COUNTED_FILES", 1)
    monkeypatch.setattr(custom, "SHARE_BYTES", 200)
    for i in range(3):
        pq.write_table(pa.table({"id": pa.array(range(i * 10, i * 10 + 10))}), tmp_path / f"{i}.pq", row_group_size=4)
    register_format(spark, "own_shares", "id bigint", storage.open_parquet, count_pieces=storage.count_row_groups, suffix=".pq")
    assert ids(spark.read.format("own_shares").load(str(tmp_path))) == list(range(30))


def test_ranges_of_a_file():
    ranges = {}
    custom._widen(ranges, pa.record_batch({"a": [1, 5], "b": ["x", None], "c": [None, None], "d": [[1], [2]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.string()), ("c", pa.int64()), ("d", pa.list_(pa.int64()))])))
    custom._widen(ranges, pa.record_batch({"a": [-2], "b": ["a"], "c": pa.array([None], pa.int64()), "d": [[1]]}))
    assert json.loads(json.dumps(ranges)) == {"a": [-2, 5], "b": ["a", "x"], "c": []}
