"""Exact top-k search against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import topk

VECTORS = "vec_id long, embedding array<double>, score string"


def plain(rows, k, asks, scale=256):
    """query_id -> [(rank, vec_id, score)], with whole numbers of any size."""
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in usable if asks(i)}:
        products = ((sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in usable if i != q)
        scores = sorted((-max(topk.NONE + 1, min(2**63 - 1, s)), i) for s, i in products)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, k=5, asks=lambda i: i % 5 == 0, partitions=3):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).repartition(partitions)
    got = topk.top_inner_products(df, F.col("vec_id") % 5 == 0, k, change=topk.quantised())
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in got.collect())


def asked(i):
    return i % 5 == 0


def vectors(n, width, seed, spread):
    r = np.random.default_rng(seed)
    basis = r.normal(size=(width, width)) * (0.7 ** np.arange(width))[:, None]
    return [(i, (x * s).tolist()) for i, (x, s) in enumerate(zip(r.normal(size=(n, width)) @ basis, np.exp(spread * r.normal(size=n))))]


@pytest.mark.parametrize(("spread", "few"), [(0.0, 1 / 16), (1.5, 1 / 16), (1.5, 1.0)])
def test_against_all_products(spark, monkeypatch, spread, few):
    for name, value in (("GROUP_QUERIES", 30), ("SEEDS", 20), ("BLOCK_ROWS", 16), ("FEW", few)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(400, 24, 1, spread)
    assert found(spark, rows) == plain(rows, 5, asked)


def test_long_vectors_end_the_search():
    rows = vectors(3000, 16, 2, 2.0)
    ids, y = np.array([i for i, _ in rows]), np.floor(256 * np.array([v for _, v in rows]))
    norms = np.sqrt((y * y).sum(axis=1))
    by = np.argsort(-norms)
    ids, y, norms = ids[by], y[by], norms[by]
    group = topk.Group(np.arange(10), ids[:10], y[:10], 5, np.linalg.svd(y)[2].T, (ids[:64], y[:64]))
    blocks = [group.offer(ids[a : a + 50], y[a : a + 50], norms[a : a + 50]) for a in range(0, 3000, 50)]
    assert not blocks[-1] and sum(blocks) < 30


def test_ties_and_repeated_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.004, -0.004]) for _ in range(4)]) for i in range(120)]
    rows += [(i, [0.004, 0.004, 0.0, 0.0]) for i in range(200, 300)]  # one vector that many rows have
    rows += [(10, [0.004] * 4), (10, [0.004] * 4), (11, [0.5] * 4), (11, [0.5] * 4), (0, rows[0][1])]
    got, want = found(spark, rows), plain(rows, 5, asked)
    assert got == want


def test_left_out_and_few(spark):
    rows = [(0, [1.0, 2.0]), (5, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, None), (None, [9.0, 9.0]), (4, [float("inf"), 0.0]), (6, [-1.0, -1.0])]
    assert found(spark, rows) == plain(rows, 5, asked)
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []
    assert found(spark, [(0, []), (5, [])]) == [(0, 1, 5, 0), (5, 1, 0, 0)]
    other = [(7, [1.0, 1.0, 1.0])]
    assert found(spark, rows + other) == plain(rows, 5, asked)


def test_scores_of_any_size(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.choice([0, 6, 7, 12, 40]) for _ in range(3)]) for i in range(60)]
    assert found(spark, rows) == plain(rows, 5, asked)


def test_the_rotation_is_that_of_the_whole_table(spark):
    rows = vectors(200, 8, 5, 0.5)
    df = spark.createDataFrame([(v,) for _, v in rows], "vector array<double>").repartition(4)
    turn = topk._rotation(df, 8)
    want = np.linalg.svd(np.array([v for _, v in rows]))[2].T
    assert np.allclose(np.abs((turn * want).sum(axis=0)), 1)
