"""Tables for iterative graph operators.

Edges are bucketed once by the end a walk leaves from, and each round appends its rows to a table
bucketed by node id. The joins of a round then find both sides in place: only the newly found ids
are shuffled, however many edges there are. The tables lie in the shared scratch folder, so a lost
executor costs only its running tasks, and the plan of a round does not contain earlier rounds.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.skew import ROWS_PER_TASK, add_salt, hot_keys, repeat_for_salts
from millrace.session import scratch_dir, shuffle_partitions


#: A frontier of up to so many nodes is handed as a list to the scan of an edge table that is larger than this: fetching
#: the list is a job of its own, which saves nothing on a small table.
PUSHED_IDS = 2000
PRUNED_BYTES = 64 << 20


class _Table:
    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.name = f"millrace_{label}_{uuid.uuid4().hex[:12]}"
        self.path = scratch_dir(spark, label)
        self.buckets = shuffle_partitions(spark)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.drop()

    def drop(self) -> None:
        """Forget the catalog entry. The files stay, and results that read them stay valid."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class EdgeTable(_Table):
    """Edges stored for walking from ``walk_from`` (``source_id`` or ``target_id``) to the other end.

    Extra columns of ``edges`` are kept and come with each step. A node with very many edges is
    spread over several buckets by salt. ``edges`` is computed twice, once to count: save edges that
    are expensive to compute, such as those extracted from texts, before walking them.

    Buckets are sorted. A step from few nodes names them in the scan, which then opens only their buckets, and of these
    only the pages that may hold them; a step from many nodes touches all buckets anyway.
    """

    def __init__(self, edges: DataFrame, walk_from: str, rows_per_task: int = ROWS_PER_TASK):
        super().__init__(edges.sparkSession, "edges")
        walk_to = {"source_id": "target_id", "target_id": "source_id"}[walk_from]
        self.extra = [c for c in edges.columns if c not in ("source_id", "target_id")]
        self.hot = hot_keys(edges, [walk_from], rows_per_task)
        placed = add_salt(edges, [walk_from], [walk_to], self.hot).select(
            F.col(walk_from).alias("from_id"), F.col(walk_to).alias("to_id"), *self.extra, "salt"
        )
        keys = ["from_id"] if self.hot is None else ["from_id", "salt"]
        (
            placed.repartition(self.buckets, *keys)
            .write.bucketBy(self.buckets, *keys)
            .sortBy("from_id")
            .option("path", self.path)
            .format("parquet")
            .saveAsTable(self.name)
        )
        self.edges = self.spark.table(self.name)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.bytes = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
        if self.hot is not None:
            self.hot = self.hot.withColumnRenamed(walk_from, "id")

    def step(self, frontier: DataFrame, n_ids: int | None = None) -> DataFrame:
        """One step from the ``id`` of each frontier row; its other columns come along.

        ``n_ids``, where known, is the number of frontier rows.
        """
        kept, edges = [c for c in frontier.columns if c != "id"], self.edges
        if n_ids is not None and n_ids <= PUSHED_IDS and self.bytes > PRUNED_BYTES:
            edges = edges.filter(F.col("from_id").isin([r.id for r in frontier.select("id").collect()]))
        if self.hot is None:
            joined = frontier.join(edges, F.col("id") == F.col("from_id"))
        else:
            spread = repeat_for_salts(frontier, ["id"], self.hot).withColumnRenamed("salt", "_salt")
            joined = spread.join(edges, (F.col("id") == F.col("from_id")) & (F.col("_salt") == F.col("salt")))
        return joined.select(F.col("to_id"), *kept, *self.extra)


class RoundTable(_Table):
    """Rows found so far, partitioned by round and bucketed by ``id``."""

    def __init__(self, spark: SparkSession, label: str, partition_by: tuple[str, ...] = ()):
        super().__init__(spark, label)
        self.partition_by = partition_by
        self.schema = None

    def append(self, df: DataFrame, round_no: int, counters: Mapping[str, Column] | None = None) -> dict[str, int]:
        """Add the rows of one round in one job; returns their number and other ``counters``."""
        seen = Observation()
        counters = {"n": F.count(F.lit(1)), **(counters or {})}
        rows = df.withColumn("round", F.lit(round_no))
        if self.schema is None:
            self.schema = rows.schema
        (
            rows.observe(seen, *(F.coalesce(c, F.lit(0)).alias(k) for k, c in counters.items()))
            .write.mode("append")
            .format("parquet")
            .partitionBy("round", *self.partition_by)
            .bucketBy(self.buckets, "id")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        return seen.get

    def all(self) -> DataFrame:
        return self.spark.table(self.name)

    def at(self, round_no: int) -> DataFrame:
        return self.all().filter(F.col("round") == round_no)

    def result(self) -> DataFrame:
        """All rows, read from the files: stays valid after the table is dropped."""
        return self.spark.read.schema(self.schema).parquet(self.path)


def check_round(round_no: int, limit: int | None) -> None:
    """A limit that a caller sets is an error when it is reached; a result is never cut short.

    Without one a walk ends by itself: every round finds something new.
    """
    if limit is not None and round_no >= limit:
        raise RuntimeError(f"no end after {limit} rounds")
