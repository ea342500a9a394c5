"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from millrace import plans
from tests.oracle_check import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert difference(plans.QUERIES[name](spark, SF), duck, plans.ORACLES[name]) is None


def test_entry_and_registry(spark):
    df = contract.entry(spark)
    assert df.columns == ["sample", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    assert df.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = physical(plans.QUERIES["acctbal_band"](spark, SF))
    assert "GreaterThan(c_acctbal,1000.0), LessThanOrEqual(c_acctbal,2000.0)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in plan


def test_filter_moves_below_the_sort(spark):
    plan = physical(plans.QUERIES["acctbal_upper"](spark, SF))
    assert plan.index("Sort") < plan.index("Filter")


def test_top_k_does_not_sort_everything(spark):
    plan = physical(plans.QUERIES["topk_two_keys"](spark, SF))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
