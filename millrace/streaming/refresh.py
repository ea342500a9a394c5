"""Tables kept current as files arrive, with Structured Streaming.

Both sinks are idempotent: a batch that runs again after a failure leaves the same table. A stream sees new files; changed,
moved and deleted ones are the matter of ``streaming.files``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from millrace.operators.ledger import latest_by
from millrace.operators.materialize import is_complete, path_exists, refresh_partitions

COMPACT_EVERY = 16
NAMED_PARTITIONS = 10_000


def arriving_files(spark: SparkSession, path: str, schema, glob: str | None = None, **options) -> DataFrame:
    """A stream over the Parquet files of a folder, those there now and those to come."""
    reader = spark.readStream.schema(schema).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _start(stream: DataFrame, checkpoint: str, mode: str, sink: Callable[[DataFrame, int], None], once: bool):
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_latest(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str],
    partition: str, once: bool = True,
) -> StreamingQuery:
    """Keep the last row of each key in a table at ``path``, partitioned by ``partition``.

    A batch rewrites only the partitions that its rows fall into. ``partition`` must depend on the
    key alone. With ``once`` the query ends when the files that are there have been handled.

    A batch is first saved as a whole beside the table. If publishing it breaks off, the batch runs again,
    finds what it saved, and publishes that: it never reads a table that is half replaced.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        saved = f"{path.rstrip('/')}/_batches/{batch_id}"
        if not is_complete(spark, saved):
            rows = batch
            if path_exists(spark, path):
                table = spark.read.schema(batch.schema).parquet(path).select(*batch.columns)
                rows = in_partitions(table, partition, batch.select(partition)).unionByName(batch)
            latest_by(rows, keys, order_by).write.mode("overwrite").parquet(saved)
        refresh_partitions(spark.read.schema(batch.schema).parquet(saved), path, partition)
        # This batch cannot run again once the next one begins.
        _delete(spark, f"{path.rstrip('/')}/_batches/{batch_id - 1}")

    return _start(stream, checkpoint, "append", upsert, once)


def in_partitions(table: DataFrame, partition: str, values: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``partition`` is among ``values``; other folders are not opened.

    Partitions are folders, whose names the driver holds anyway. Beyond ``NAMED_PARTITIONS`` values they are joined instead.
    """
    some = [r[0] for r in values.distinct().limit(NAMED_PARTITIONS + 1).collect()]
    if len(some) > NAMED_PARTITIONS:
        named = values.distinct().withColumnRenamed(partition, "_named")
        return table.join(named, F.col(partition).eqNullSafe(F.col("_named")), "left_semi")
    found = F.col(partition).isin([v for v in some if v is not None])
    return table.filter(found | F.col(partition).isNull() if None in some else found)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def latest_status_changes(
    changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order_by: Sequence[str], once: bool = True
) -> StreamingQuery:
    """Keep the latest status per key as streaming state; each batch writes the keys that changed.

    A batch writes ``batch_id=<its own>`` and nothing else that it would read, so one that broke off anywhere does the same again. Every
    ``COMPACT_EVERY`` batches, those before it, which are committed, are folded into a new folder ``_upto=<the last of them>``, written by no
    other batch. What that folder replaces is deleted by a later batch, when the folding one is committed itself.
    """
    latest = changes.groupBy(*keys).agg(
        F.max_by("status", F.struct(*order_by)).alias("status"), F.max(F.struct(*order_by)).alias("as_of")
    )

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _drop_folded(spark, path, batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if batch_id % COMPACT_EVERY == 0 and batch_id > 0:
            rows = _changes(spark, path, batch.schema, before=batch_id)
            latest_by(rows, keys, ["batch_id"]).drop("batch_id").write.mode("overwrite").parquet(f"{path}/{FOLDED}{batch_id - 1}")

    return _start(latest, checkpoint, "update", add, once)


FOLDED, BATCH = "_upto=", "batch_id="


def _numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders ``prefix<number>`` under ``path``, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    numbers = sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))
    return [n for n in numbers if is_complete(spark, f"{path}/{prefix}{n}")]


def _drop_folded(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete what a folder replaces that an earlier, committed batch has made."""
    if not path_exists(spark, path):
        return
    folded = [n for n in _numbered(spark, path, FOLDED) if n < batch_id - 1]
    if folded:
        for prefix, last in ((BATCH, folded[-1]), (FOLDED, folded[-1] - 1)):
            for number in _numbered(spark, path, prefix):
                if number <= last:
                    _delete(spark, f"{path}/{prefix}{number}")


def _changes(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Changes of all batches with their ``batch_id``; folded ones bear that of the last batch in them."""
    folded = [n for n in _numbered(spark, path, FOLDED) if before is None or n < before]
    upto = folded[-1] if folded else -1
    batches = [n for n in _numbered(spark, path, BATCH) if n > upto and (before is None or n < before)]
    rows = spark.createDataFrame([], StructType([*schema, StructField("batch_id", LongType())]))
    if batches:
        reader = spark.read.schema(rows.schema).option("basePath", path)
        rows = reader.parquet(*(f"{path}/{BATCH}{n}" for n in batches)).select(*rows.columns)
    if folded:
        whole = spark.read.schema(schema).parquet(f"{path}/{FOLDED}{upto}")
        rows = rows.unionByName(whole.withColumn("batch_id", F.lit(upto).cast("long")))
    return rows


def read_latest_changes(spark: SparkSession, path: str, keys: Sequence[str], schema=None) -> DataFrame:
    """The current state from the changes of all batches. With ``schema`` also before the first batch."""
    folders = []
    if path_exists(spark, path):
        folders = [f"{path}/{prefix}{n}" for prefix in (BATCH, FOLDED) for n in _numbered(spark, path, prefix)]
    if not folders:
        if schema is None:
            raise ValueError(f"no batch has been written to {path} yet")
        return spark.createDataFrame([], schema)
    changes = _changes(spark, path, spark.read.parquet(folders[-1]).schema)
    return latest_by(changes, keys, ["batch_id"]).drop("batch_id", "as_of")
