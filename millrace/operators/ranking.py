"""Positions in a total order, without sending the rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import scan
from millrace.session import stored, shuffle_partitions


def with_position(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    position: str = "position",
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based position in the order of ``order_by``, per group of ``within`` if given.

    A plain ``row_number`` window puts each group, and without groups the whole table, into one
    task. Here the rows are range-partitioned by group and order, which splits a large group. Rows
    are numbered inside each partition, and the group's row count in earlier partitions is added.
    ``order_by`` must be unique within a group, else equal rows are numbered in any order.
    """
    spark = df.sparkSession
    partitions = partitions or shuffle_partitions(spark)
    # Range bounds come from a sample, so the partitioning is fixed by storing it before its use.
    ranged = stored(
        df.repartitionByRange(partitions, *within, *order_by).withColumn("_range", F.spark_partition_id())
    )
    counts = ranged.groupBy("_range", *within).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*within)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range",
        *within,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_total"),
        F.count(F.lit(1)).over(group).alias("_ranges"),
    )
    # Groups inside one partition need no offset. A partition is shared by at most two groups that
    # go beyond it, its first and its last, so this side has at most two rows per partition.
    crossing = offsets.filter(F.col("_ranges") > 1).select(
        F.col("_range").alias("_o_range"),
        *(F.col(c).alias(f"_o_{c}") for c in within),
        "_before",
        "_total",
    )
    same = F.col("_range") == F.col("_o_range")
    for column in within:
        same = same & F.col(column).eqNullSafe(F.col(f"_o_{column}"))
    local = Window.partitionBy("_range", *within)
    numbered = ranged.withColumn("_local", F.row_number().over(local.orderBy(*order_by)))
    if total:
        numbered = numbered.withColumn("_local_total", F.count(F.lit(1)).over(local))
    joined = numbered.join(F.broadcast(crossing), same, "left")
    place = (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint")
    columns = [*df.columns, place.alias(position)]
    if total:
        columns.append(F.coalesce("_total", "_local_total").cast("bigint").alias(total))
    return joined.select(*columns)


def paged_lists(
    df: DataFrame, keys: Sequence[str], value: str, page_size: int = 1000, lists: str = "values"
) -> DataFrame:
    """Sorted lists of ``value`` per key: ``(keys..., page, values)``, pages numbered from 0.

    A key with at most ``page_size`` values has one row. A longer list continues on further pages,
    so no row grows with the data.
    """
    placed = scan(df.select(*keys, value), [value], keys, number="position")
    page = F.expr(f"(position - 1) div {int(page_size)}").alias("page")
    items = F.sort_array(F.collect_list(value))
    return placed.groupBy(*keys, page).agg(items.alias(lists))
