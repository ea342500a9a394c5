"""Appending by key opens only the files that may hold a key."""

import numpy as np
import pytest

from millrace.operators import keyfilter
from millrace.operators import materialize as m
from millrace.session import scratch_dir

SCHEMA = "k bigint, part string, v string"


def test_a_filter_misses_no_key_and_passes_few_others():
    r = np.random.default_rng(1)
    for n in (1, 3, 1000, 50_000):
        keys = r.integers(-(2**63), 2**63 - 1, n)
        table = keyfilter.static_filter(keys)
        assert all(keyfilter.any_held(table, keys[i : i + 1]) for i in range(min(n, 300)))
        assert keyfilter.any_held(table, keys) and not keyfilter.any_held(table, keys[:0])
    others = r.integers(-(2**63), 2**63 - 1, 5000)
    assert sum(keyfilter.any_held(table, others[i : i + 1]) for i in range(5000)) < 50


def loaded(spark, rows, files=1):
    return spark.createDataFrame(rows, SCHEMA).repartition(files)


@pytest.fixture
def opened(spark, monkeypatch):
    """The lists of files that were chosen."""
    found, choose = [], keyfilter.files_that_may_hold

    def noted(*args):
        found.append(choose(*args))
        return found[-1]

    monkeypatch.setattr(keyfilter, "files_that_may_hold", noted)
    return found


def test_untouched_files_are_not_read(spark, opened):
    path = scratch_dir(spark, "keys")
    for load in range(4):  # ranges apart
        m.append_missing(loaded(spark, [(load * 100 + i, "a", "x") for i in range(50)]), path, ["k"])
    assert [len(f) for f in opened] == [0, 0, 0]
    m.append_missing(loaded(spark, [(120, "a", "again"), (170, "a", "new")]), path, ["k"])
    assert len(opened[-1]) == 1
    # In the range of every file, in the filter of none.
    for load in range(3):
        m.append_missing(loaded(spark, [(load + i * 1000 + 10_000, "a", "x") for i in range(40)]), path, ["k"])
    before = len(opened[-1])
    got = m.append_missing(loaded(spark, [(10_500, "a", "between")]), path, ["k"])
    assert before == 0 and len(opened[-1]) == 0
    assert got.count() == 4 * 50 + 1 + 3 * 40 + 1 and got.select("k").distinct().count() == got.count()


def test_deleted_files_skip_nothing_they_should_not(spark, opened, monkeypatch):
    path = scratch_dir(spark, "keys")
    rows = [(None, "a", "x"), (1, None, "x"), (1, "a", "x"), (None, None, "x")]
    for _ in range(2):
        assert m.append_missing(loaded(spark, rows, 2), path, ["k", "part"]).count() == 4
    loaded(spark, [(7, "a", "from elsewhere")]).write.mode("append").parquet(path)  # a file without an entry
    assert m.append_missing(loaded(spark, [(7, "a", "again"), (8, "a", "new")]), path, ["k", "part"]).count() == 6
    monkeypatch.setattr(keyfilter, "PROBED_KEYS", 0)  # by ranges alone
    assert m.append_missing(loaded(spark, rows + [(7, "a", "z"), (9, "a", "z")]), path, ["k", "part"]).count() == 7
    assert m.append_missing(loaded(spark, [(1, "b", "z")]), path, ["k"]).count() == 7  # by another key: entries of its own
    assert m.append_missing(loaded(spark, [(1, "b", "z"), (77, "b", "z")]), path, ["k"]).count() == 8


def test_text_formats_are_read_whole(spark):
    path = scratch_dir(spark, "keys")
    for _ in range(2):
        got = m.append_missing(loaded(spark, [(1, "a", "x"), (2, "b", "y")]), path, ["k"], "csv")
    assert got.count() == 2
