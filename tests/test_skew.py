"""Hot keys and positions, against the plain Spark forms."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import ranking, skew


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has the key 0; some keys are NULL."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97)
    return spark.range(3000).select(key.alias("k"), F.col("id").alias("v")).cache()


def test_hot_keys(spark, skewed):
    hot = {r.k: r.n_salts for r in skew.hot_keys(skewed, ["k"], rows_per_task=500).collect()}
    assert set(hot) == {0} and hot[0] >= 2
    assert skew.hot_keys(skewed, ["k"], rows_per_task=5000) is None
    assert skew.hot_keys(skewed.filter("false"), ["k"]) is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, skewed, how):
    one = spark.range(0, 90).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    plain = skewed.join(one, ["k"], how)
    salted = skew.join_many_to_one(skewed, one, ["k"], how, rows_per_task=100)
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_salts_spread_a_hot_key(spark, skewed):
    hot = skew.hot_keys(skewed, ["k"], rows_per_task=100)
    sizes = [r["count"] for r in skew.add_salt(skewed, ["k"], ["v"], hot).filter("k = 0").groupBy("salt").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 250


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_positions_in_groups(spark, skewed, partitions):
    w = Window.partitionBy("k")
    plain = skewed.select(
        "k", "v",
        F.row_number().over(w.orderBy("v")).cast("bigint").alias("position"),
        F.count(F.lit(1)).over(w).alias("total"),
    )
    ours = ranking.with_position(skewed, ["v"], ["k"], total="total", partitions=partitions)
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0


def test_positions_over_all_rows(spark, skewed):
    ours = ranking.with_position(skewed.select("v"), ["v"], total="n", partitions=9)
    assert ours.filter("position <> v + 1 OR n <> 3000").count() == 0 and ours.count() == 3000


def test_a_large_group_is_split_over_tasks(spark, skewed):
    ours = ranking.with_position(skewed.filter("k = 0"), ["v"], ["k"], partitions=8)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan
    ranged = skewed.filter("k = 0").repartitionByRange(8, "k", "v")
    assert ranged.select(F.spark_partition_id().alias("p")).distinct().count() == 8


def test_pages(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "k string, v int")
    rows = ranking.paged_lists(df, ["k"], "v", page_size=3).orderBy("k", "page").collect()
    assert [(r.k, r.page, r["values"]) for r in rows] == [("a", 0, [0, 1, 2]), ("a", 1, [3, 4, 5]), ("a", 2, [6]), ("b", 0, [1])]
