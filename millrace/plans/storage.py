"""Sources and sinks: each query writes a table to the scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.materialize import (
    append_missing,
    fan_out,
    is_complete,
    materialize,
    materialize_many,
    read_or_compute,
    refresh_partitions,
)
from millrace.plans.catalog import registered
from millrace.session import read_table, scratch_dir
from millrace.sinks.files import write, write_by_key
from millrace.sources import files, jdbc, sketches
from millrace.sources.custom import register_format


@registered("csv_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    path = write(events, scratch_dir(spark, "csv"), "csv")
    return files.read_csv(spark, path, events.schema)


@registered("text_scan", "SELECT p_name AS value FROM part")
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(read_table(spark, sf_dir, "part").select("p_name"), scratch_dir(spark, "text"), "text")
    return files.read_text(spark, path)


@registered("json_scan", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    path = write(documents, scratch_dir(spark, "json"), "json")
    return files.read_json(spark, path, documents.schema)


@registered(
    "matrix_scan",
    """
    SELECT vec_id, UNNEST(range(len(embedding))) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS value FROM embeddings
    """,
)
def matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read_table(spark, sf_dir, "embeddings")
    row = F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>"))
    path = write(embeddings.select(row.alias("values")), scratch_dir(spark, "matrix"), "matrix")
    numbers = files.read_matrix(spark, path)
    return numbers.select(
        F.col("values")[0].cast("bigint").alias("vec_id"),
        F.posexplode(F.slice("values", F.lit(2), F.size("values") - 1)).alias("dim", "value"),
    ).withColumn("dim", F.col("dim").cast("bigint"))


@registered(
    "file_discovery",
    """
    SELECT 'c_mktsegment=' || c_mktsegment AS folder, count(*) AS n_lines, CAST(sum(length(c_name)) AS BIGINT) AS n_chars,
           CAST(sum(length(c_name) + 1) AS BIGINT) AS n_bytes
    FROM customer GROUP BY c_mktsegment
    """,
)
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of files under one root; the glob finds only the text files, at any depth, with their sizes and texts."""
    customer = read_table(spark, sf_dir, "customer")
    root = scratch_dir(spark, "tree")
    write_by_key(customer.select("c_mktsegment", "c_name"), "c_mktsegment", f"{root}/nested", "text")
    write(read_table(spark, sf_dir, "nation"), f"{root}/other", "csv")
    listed = files.discover_files(spark, root, "*.txt").groupBy(_folder_of("relative_path")).agg(F.sum("size_bytes").alias("n_bytes"))
    lines = files.read_sources(spark, root, "*.txt").select(_folder_of("relative_path"), F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))
    counted = lines.groupBy("folder").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
    return counted.join(listed, "folder")


def _folder_of(path: str):
    return F.element_at(F.split(path, "/"), -2).alias("folder")


@registered(
    "jdbc_scan_predicates",
    """
    WITH b AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders),
    c AS (SELECT DISTINCT lo + (hi - lo) * i // 8 AS cut FROM b, range(1, 8) t(i)),
    r AS (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM c WHERE cut <= o_custkey) AS part FROM orders)
    SELECT CAST(part AS BIGINT) AS partition_id, count(*) AS n_rows, min(o_custkey) AS lowest, max(o_custkey) AS highest
    FROM r GROUP BY part
    """,
)
def jdbc_scan_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the predicates of an 8-way warehouse scan would split ``orders``."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey")
    lower, upper = orders.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    predicates = jdbc.range_predicates("o_custkey", jdbc.stride_bounds(lower, upper, 8))
    matches = F.array_compact(F.array(*(F.when(F.expr(p), F.lit(i).cast("bigint")) for i, p in enumerate(predicates))))
    return (
        orders.select(F.explode(matches).alias("partition_id"), "o_custkey")
        .groupBy("partition_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("o_custkey").alias("lowest"),
            F.max("o_custkey").alias("highest"),
        )
    )


@registered(
    "jdbc_sketched_bounds",
    """
    SELECT count(*) AS n_rows, count(DISTINCT year(l_shipdate)) AS n_loads, CAST(8 AS BIGINT) AS n_partitions, true AS each_in_one, true AS balanced
    FROM lineitem
    """,
)
def jdbc_sketched_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads by year leave sketches of a skewed column; the bounds of a scan of all of them come from these alone."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), (F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity")).cast("bigint").alias("weight")
    )
    path = scratch_dir(spark, "sketches")
    years = sorted(r.year for r in lines.select("year").distinct().collect())
    for year in years:
        sketches.record_load(lines.filter(F.col("year") == year), path, str(year), ["weight"])
    predicates = jdbc.range_predicates("weight", sketches.sketched_bounds(spark, path, "weight", 8))
    matches = F.array_compact(F.array(*(F.when(F.expr(p), F.lit(i)) for i, p in enumerate(predicates))))
    placed = lines.select(matches.alias("parts"))
    sizes = placed.groupBy("parts").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("n_rows"),
        F.lit(len(years)).cast("bigint").alias("n_loads"),
        F.count(F.lit(1)).alias("n_partitions"),
        F.bool_and(F.size("parts") == 1).alias("each_in_one"),
        (F.max("n") <= F.lit(1.1) * F.sum("n") / 8).alias("balanced"),
    )


def open_parquet(stream, piece):
    """Record batches of one row group."""
    import pyarrow.parquet as pq

    yield from pq.ParquetFile(stream).iter_batches(row_groups=[piece])


def count_row_groups(stream):
    import pyarrow.parquet as pq

    return pq.ParquetFile(stream).metadata.num_row_groups


def open_feather(stream, piece, columns):
    """One record batch of an Arrow file; other columns than those wanted are not read."""
    import pyarrow as pa

    names = pa.ipc.open_file(stream).schema.names
    stream.seek(0)
    wanted = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns])
    yield pa.ipc.open_file(stream, options=wanted).get_batch(piece).select(columns)


def count_feather_batches(stream):
    import pyarrow as pa

    return pa.ipc.open_file(stream).num_record_batches


def save_feather(batches, stream):
    import pyarrow as pa

    first = next(batches)
    with pa.ipc.new_file(stream, first.schema) as out:
        out.write_batch(first)
        for batch in batches:
            out.write_batch(batch)


@registered(
    "custom_source",
    """
    SELECT o_orderstatus, count(*) AS n_orders, max(o_totalprice) AS highest FROM orders GROUP BY o_orderstatus
    """,
)
def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a format that Spark does not know, read in parallel over record batches, two columns only."""
    orders = read_table(spark, sf_dir, "orders")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema)
    register_format(spark, "arrow_orders", schema, open_feather, save_feather, count_feather_batches, ".arrow")
    path = scratch_dir(spark, "orders")
    orders.write.format("arrow_orders").mode("append").save(path)
    read = spark.read.format("arrow_orders").option("columns", "o_orderstatus,o_totalprice").load(path)
    return read.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("highest"))


@registered(
    "custom_target",
    """
    SELECT 'saved' AS step, c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 5000
    UNION ALL
    SELECT 'refreshed', c_custkey, upper(c_name), c_acctbal + 1 FROM customer WHERE c_acctbal + 1 > 5000
    """,
)
def custom_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's format as a target: saved once, read instead of computed, then refreshed from its own content."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in customer.schema)
    register_format(spark, "arrow_target", schema, open_feather, save_feather, count_feather_batches, ".arrow")
    path = scratch_dir(spark, "target")
    rich = F.col("c_acctbal") > 5000
    read_or_compute(spark, path, lambda: customer, "arrow_target")
    saved = read_or_compute(spark, path, None, "arrow_target").filter(rich)
    first = materialize(saved.select(F.lit("saved").alias("step"), "*"), scratch_dir(spark, "saved"))
    old = read_or_compute(spark, path, None, "arrow_target")
    more = old.select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    fresh = read_or_compute(spark, path, lambda: more, "arrow_target", full_refresh=True).filter(rich)
    return first.unionByName(fresh.select(F.lit("refreshed").alias("step"), "*"))


@registered("custom_sink", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def custom_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-written format, saved and opened again."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in customer.schema)
    register_format(spark, "arrow_file", schema, open_feather, save_feather, count_feather_batches, ".arrow")
    path = scratch_dir(spark, "arrow")
    customer.write.format("arrow_file").mode("append").save(path)
    return spark.read.format("arrow_file").load(path)


@registered(
    "materialize_passthrough",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def materialize_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    saved = materialize(lineitem, scratch_dir(spark, "lineitem"))
    return saved.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").cast("bigint").alias("quantity")
    )


@registered(
    "multi_target",
    """
    SELECT 'low' AS target, c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal <= 1000
    UNION ALL
    SELECT 'band' AS target, c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_acctbal <= 2000
    """,
)
def multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    balance = F.col("c_acctbal")
    low, band = materialize_many(
        [customer.filter(balance <= 1000), customer.filter((balance > 1000) & (balance <= 2000))],
        [(scratch_dir(spark, "low"), "csv"), (scratch_dir(spark, "band"), "json")],
        shared=customer,
    )
    return low.select(F.lit("low").alias("target"), "*").unionByName(band.select(F.lit("band").alias("target"), "*"))


@registered(
    "keyed_fanout",
    "SELECT o_orderpriority, o_orderkey, o_custkey, o_totalprice FROM orders",
)
def keyed_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    path = fan_out(orders, "o_orderpriority", scratch_dir(spark, "fanout"))
    return spark.read.schema(orders.schema).parquet(path)


@registered("read_or_compute", "SELECT o_orderkey, o_totalprice, 'first' AS computed_by FROM orders WHERE o_orderstatus = 'F'")
def read_or_compute_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "finished")

    def compute(label):
        return orders.filter(F.col("o_orderstatus") == "F").select(
            "o_orderkey", "o_totalprice", F.lit(label).alias("computed_by")
        )

    read_or_compute(spark, path, lambda: compute("first"))
    return read_or_compute(spark, path, lambda: compute("second"))


@registered("skip_when_done", "SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier")
def skip_when_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_table(spark, sf_dir, "supplier")
    path = scratch_dir(spark, "doubled")
    read_or_compute(spark, path, lambda: supplier.select("s_suppkey", (F.col("s_acctbal") * 2).alias("doubled")))

    def would_change_it():
        return supplier.select("s_suppkey", F.lit(0.0).alias("doubled"))

    return read_or_compute(spark, path, would_change_it, done=lambda: is_complete(spark, path))


@registered("full_refresh", "SELECT s_suppkey, s_acctbal * 3 AS scaled FROM supplier")
def full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_table(spark, sf_dir, "supplier")
    path = scratch_dir(spark, "scaled")

    def scaled(factor):
        return supplier.select("s_suppkey", (F.col("s_acctbal") * factor).alias("scaled"))

    read_or_compute(spark, path, lambda: scaled(2))
    return read_or_compute(spark, path, lambda: scaled(3), done=lambda: True, full_refresh=True)


@registered(
    "incremental_append",
    """
    SELECT o_orderkey, o_totalprice,
           CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'first load' ELSE 'appended' END AS loaded_by
    FROM orders
    """,
)
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "orders")
    early = orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    append_missing(early.select("o_orderkey", "o_totalprice", F.lit("first load").alias("loaded_by")), path, ["o_orderkey"])
    return append_missing(
        orders.select("o_orderkey", "o_totalprice", F.lit("appended").alias("loaded_by")), path, ["o_orderkey"]
    )


@registered(
    "partition_refresh",
    """
    SELECT o_orderkey, o_totalprice, o_orderstatus,
           CASE WHEN o_orderstatus = 'P' THEN 'refreshed' ELSE 'first load' END AS loaded_by
    FROM orders
    """,
)
def partition_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch_dir(spark, "by-status")
    refresh_partitions(orders.withColumn("loaded_by", F.lit("first load")), path, "o_orderstatus")
    late = orders.filter(F.col("o_orderstatus") == "P").withColumn("loaded_by", F.lit("refreshed"))
    return refresh_partitions(late, path, "o_orderstatus")
