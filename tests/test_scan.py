"""Segmented scans against plain loops."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from millrace.operators.scan import scan

ROWS = "a string, b long, t long, v long, w string"


def plain(rows, keys, with_keys=True):
    order = {"a": 0, "b": 1}
    key = lambda r: tuple((r[order[k]] is not None, r[order[k]] if r[order[k]] is not None else 0) for k in keys)
    out = []
    for _, group in groupby(sorted(rows, key=lambda r: (key(r), r[2])), key=key):
        group, total = list(group), 0
        for i, r in enumerate(group):
            total += r[3] or 0
            out.append((*r, i + 1, total, group[i + 1][4] if i + 1 < len(group) else None, group[i - 1][2] if i else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("keys", "partitions", "hot"), [([], 5, 0), (["a"], 7, 200), (["a", "b"], 4, 0), (["a", "b"], 16, 300), (["b"], 1, 0)])
def test_against_loops(spark, keys, partitions, hot):
    r = random.Random(len(keys) * partitions)
    times = list(range(500))
    r.shuffle(times)
    rows = [(None if i < hot else r.choice(["x", "y", None, ""]), 1 if i < hot else r.choice([None, 1, 2, 3]), t, r.choice([None, 1, -5, 7]), r.choice([None, "p", "q"])) for i, t in enumerate(times)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = scan(spark.createDataFrame(rows, ROWS), ["t"], keys, "n", {"s": "v"}, {"next": "w"}, {"last": "t"}, partitions).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == plain(rows, keys)


def test_no_rows_and_one(spark):
    empty = spark.createDataFrame([], ROWS)
    assert scan(empty, ["t"], ["a"], "n", {"s": "v"}, {"next": "w"}).collect() == []
    one = spark.createDataFrame([("x", 1, 2, 3, "q")], ROWS)
    assert [tuple(r) for r in scan(one, ["t"], [], "n", lead={"next": "w"}).collect()] == [("x", 1, 2, 3, "q", 1, None)]


def test_one_range_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = scan(df, ["id"], ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Exchange range" not in plan  # what is stored was shuffled once, and is joined to a broadcast
