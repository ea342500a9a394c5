"""Named references, parameters, and string helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import params, text
from millrace.operators.datasets import Datasets
from millrace.plans.catalog import registered
from millrace.session import read_table


@registered(
    "named_ref",
    """
    SELECT n_name, count(*) AS n_customers, max(c_acctbal) AS highest
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_acctbal > 0 GROUP BY n_name
    """,
)
def named_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = Datasets(spark)
    datasets.publish("extract.customers", read_table(spark, sf_dir, "customer"))
    datasets.publish("extract.nations", read_table(spark, sf_dir, "nation"))
    datasets.step("solvent", lambda c: c.filter(F.col("c_acctbal") > 0), "extract.customers")
    return datasets.sql(
        """
        SELECT n_name, count(*) AS n_customers, max(c_acctbal) AS highest
        FROM solvent JOIN `extract.nations` ON c_nationkey = n_nationkey GROUP BY n_name
        """
    )


@registered(
    "ctx_lookup",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k, 'batch' AS mode FROM events
    """,
)
def ctx_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", params.json_to_map(F.col("props")).alias("ctx"))
    return events.select(
        "event_id",
        params.ctx_lookup(F.col("ctx"), "k").alias("k"),
        params.ctx_lookup(F.col("ctx"), "mode", "batch").alias("mode"),
    )


@registered(
    "ctx_merge",
    """
    SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1') AS k, event_type AS step,
           1 + len(list_distinct(list_concat(['k'], json_keys(props)))) AS n_keys
    FROM events
    """,
)
def ctx_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = F.create_map(F.lit("k"), F.lit("-1"), F.lit("step"), F.col("event_type"))
    both = read_table(spark, sf_dir, "events").select(
        "event_id", project.alias("project"), params.json_to_map(F.col("props")).alias("runtime")
    )
    merged = both.select("event_id", params.ctx_merge(F.col("project"), F.col("runtime")).alias("ctx"))
    return merged.select(
        "event_id",
        F.try_element_at("ctx", F.lit("k")).alias("k"),
        F.try_element_at("ctx", F.lit("step")).alias("step"),
        F.size("ctx").alias("n_keys"),
    )


@registered(
    "ctx_stringify",
    """
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_custkey AS VARCHAR) AS customer_text,
           CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END AS is_large
    FROM orders
    """,
)
def ctx_stringify(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.create_map(F.lit("key"), F.col("o_orderkey"), F.lit("customer"), F.col("o_custkey"))
    flags = F.create_map(F.lit("is_large"), F.col("o_totalprice") > 100000)
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", params.ctx_stringify(numbers).alias("n"), params.ctx_stringify(flags).alias("f")
    )
    return orders.select(
        "o_orderkey",
        F.col("n")["key"].alias("key_text"),
        F.col("n")["customer"].alias("customer_text"),
        F.col("f")["is_large"].alias("is_large"),
    )


@registered(
    "json_to_map",
    """
    SELECT event_id, UNNEST(json_keys(props)) AS key,
           json_extract_string(props, '$.' || UNNEST(json_keys(props))) AS value
    FROM events
    """,
)
def json_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", params.json_to_map(F.col("props"), True).alias("m"))
    return events.select("event_id", F.explode("m").alias("key", "value"))


@registered("text_append", "SELECT doc_id, text || chr(10) || 'from ' || source AS text FROM documents")
def text_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    closing = F.concat(F.lit("from "), F.col("source"))
    return documents.select("doc_id", text.text_append(F.col("text"), closing).alias("text"))


@registered("string_tail", "SELECT doc_id, right(text, 5) AS tail FROM documents")
def string_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.string_tail(F.col("text"), 5).alias("tail"))


@registered("name_slug", "SELECT p_partkey, replace(lower(p_name), ' ', '_') || '.txt' AS file_name FROM part")
def name_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", text.file_slug(F.col("p_name")).alias("file_name"))


@registered(
    "path_parts",
    r"""
    WITH p AS (
        SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '') || '.py', '\.py$', '') AS module FROM pages
    )
    SELECT page_id, module,
           array_to_string(string_split(module, '/')[:-2], '/') AS parent,
           string_split(module, '/')[-1] AS leaf,
           len(string_split(module, '/')) AS depth
    FROM p
    """,
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".py"))
    pages = read_table(spark, sf_dir, "pages").select("page_id", text.path_parts(path).alias("p"))
    return pages.select("page_id", "p.module", "p.parent", "p.leaf", F.col("p.depth").cast("bigint").alias("depth"))
