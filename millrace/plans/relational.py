"""Projections, filters, sorts and top-k over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.datasets import Datasets
from millrace.plans.catalog import registered
from millrace.session import read_table


@registered(
    "sql_passthrough",
    """
    SELECT c_nationkey, count(*) AS n_customers, min(c_acctbal) AS lowest, max(c_acctbal) AS highest
    FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey
    """,
)
def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = Datasets(spark, {"segment": "MACHINERY"})
    return datasets.sql(
        """
        SELECT c_nationkey, count(*) AS n_customers, min(c_acctbal) AS lowest, max(c_acctbal) AS highest
        FROM {customer} WHERE c_mktsegment = :segment GROUP BY c_nationkey
        """,
        params={"segment": "BUILDING"},
        customer=read_table(spark, sf_dir, "customer"),
    )


@registered(
    "topk_two_keys",
    "SELECT c_mktsegment, c_name FROM customer ORDER BY c_mktsegment, c_name LIMIT 10",
)
def topk_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    return customer.select("c_mktsegment", "c_name").orderBy("c_mktsegment", "c_name").limit(10)


def segment_top(customer: DataFrame, segment: str, rows: int = 50) -> DataFrame:
    """The first ``rows`` customers of one market segment, by key."""
    return customer.filter(F.col("c_mktsegment") == segment).orderBy("c_custkey").limit(rows)


@registered(
    "segment_sample",
    """
    (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 50)
    UNION ALL
    (SELECT * FROM customer WHERE c_mktsegment = 'HOUSEHOLD' ORDER BY c_custkey LIMIT 50)
    """,
)
def segment_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    return segment_top(customer, "MACHINERY").unionByName(segment_top(customer, "HOUSEHOLD"))


@registered("acctbal_upper", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal <= 1000")
def acctbal_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    # Identifiers resolve without regard to case, as they do in the warehouses the names come from.
    return customer.sort(F.col("C_ACCTBAL").asc()).filter(F.col("C_ACCTBAL") <= 1000)


@registered(
    "acctbal_band",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal <= 2000",
)
def acctbal_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return customer.filter(F.col("c_acctbal") > 1000).filter(F.col("c_acctbal") <= 2000)


def filter_samples(machinery: DataFrame, household: DataFrame) -> dict[str, DataFrame]:
    balance = F.col("C_ACCTBAL")
    return {
        "machinery": machinery.sort(balance.asc()).filter(balance <= 1000),
        "household": household.sort(balance.asc()).filter(balance > 1000).filter(balance <= 2000),
    }


@registered(
    "two_stage_flow",
    """
    SELECT 'machinery' AS sample, * FROM
        (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 50)
    WHERE c_acctbal <= 1000
    UNION ALL
    SELECT 'household' AS sample, * FROM
        (SELECT * FROM customer WHERE c_mktsegment = 'HOUSEHOLD' ORDER BY c_custkey LIMIT 50)
    WHERE c_acctbal > 1000 AND c_acctbal <= 2000
    """,
)
def two_stage_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: a warehouse step with two outputs feeds a filtering step with two outputs."""
    customer = read_table(spark, sf_dir, "customer")
    datasets = Datasets(spark)
    datasets.step(
        "warehouse",
        lambda: {s.lower(): segment_top(customer, s) for s in ("MACHINERY", "HOUSEHOLD")},
    )
    datasets.step("filtered", filter_samples, "warehouse.machinery", "warehouse.household")
    tagged = [
        datasets.ref("filtered", sample).select(F.lit(sample).alias("sample"), "*")
        for sample in ("machinery", "household")
    ]
    return tagged[0].unionByName(tagged[1])


@registered(
    "unordered_limit_count",
    "SELECT count(*) AS n_rows FROM (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' LIMIT 50)",
)
def unordered_limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which rows an unordered limit returns is open; how many is not.
    customer = read_table(spark, sf_dir, "customer")
    sample = customer.filter(F.col("c_mktsegment") == "MACHINERY").limit(50)
    return sample.agg(F.count(F.lit(1)).alias("n_rows"))
