"""A derived table that follows its source files: new, changed, moved and deleted ones.

Beside the table lies a listing of the files it was made from, and which partitions each of them feeds. A refresh lists the files again,
compares both listings with a full outer join, and makes anew only the partitions that differing files feed or fed, from
those files alone that feed them. Listings are versioned, and what a refresh is about to publish is written down first, so that one that broke off
is made up for by the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.materialize import is_complete, path_exists, refresh_partitions
from millrace.session import stored
from millrace.sources.files import discover_files, relative_path
from millrace.streaming.refresh import _delete, _numbered

VERSION, PENDING = "version=", "pending=version="


@dataclass
class Refresh:
    """What a refresh did: numbers of files and of partitions."""

    added: int
    changed: int
    removed: int
    partitions: int


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(relative_path, change)`` of two listings: added, changed or removed. A moved file is removed here and added there."""
    was = before.select("relative_path", F.struct("size_bytes", "modified").alias("was"))
    both = now.select("relative_path", F.struct("size_bytes", "modified").alias("is")).join(was, "relative_path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("relative_path", change.alias("change")).filter("change IS NOT NULL")


def follow_files(
    spark: SparkSession,
    root: str,
    path: str,
    schema: StructType,
    partition: str,
    extract: Callable[[DataFrame], DataFrame],
    build: Callable[[DataFrame], DataFrame],
    glob: str = "*.parquet",
    fmt: str = "parquet",
) -> Refresh:
    """Bring the table at ``path``, in folders by ``partition``, in line with the files under ``root``.

    ``extract`` maps the files' rows to rows with the partition column, row by row; ``build`` makes of them the rows of the table, each partition
    from its own rows only. A file counts as changed when its length or its time does.
    """
    path, root = path.rstrip("/"), root.rstrip("/")
    listings = f"{path}/_files"
    versions = _numbered(spark, listings, VERSION) if path_exists(spark, listings) else []
    version = versions[-1] + 1 if versions else 0
    now = stored(discover_files(spark, root, glob))
    kind = StructType(list(now.schema))
    before = spark.read.parquet(f"{listings}/{VERSION}{versions[-1]}/files") if versions else spark.createDataFrame([], kind)
    changes = stored(file_changes(before, now))
    counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    pending = f"{listings}/{PENDING}{version}"
    if not counts and not path_exists(spark, pending) and versions:
        return Refresh(0, 0, 0, 0)

    names = schema.fieldNames()

    def rows_of(files: DataFrame) -> DataFrame:
        """Extracted rows with their file, from these files only: the reader gets their names, as it would by listing."""
        some = [f"{root}/{r.relative_path}" for r in files.select("relative_path").collect()]
        if not some:
            return extract(spark.createDataFrame([], schema).withColumn("_file", F.lit(None).cast("string")))
        read = spark.read.schema(schema).format(fmt).load(some)
        return extract(read.select(*names, relative_path(F.col("_metadata.file_path"), root).alias("_file")))

    news = changes.filter("change <> 'removed'").select("relative_path")
    fresh_feeds = stored(rows_of(news).select(F.col("_file").alias("relative_path"), partition).distinct())
    feeds = spark.read.parquet(f"{listings}/{VERSION}{versions[-1]}/feeds") if versions else fresh_feeds.limit(0)
    differing = changes.select("relative_path")
    kept = feeds.join(differing, "relative_path", "left_anti")
    touched = fresh_feeds.select(partition).union(feeds.join(differing, "relative_path", "left_semi").select(partition)).distinct()
    # What an earlier attempt may have published already is made anew as well.
    if is_complete(spark, pending):
        touched = touched.union(spark.read.schema(touched.schema).parquet(pending)).distinct()
    touched = stored(touched)
    touched.write.mode("overwrite").parquet(pending)
    listed = [r[0] for r in touched.collect()]  # as many as the table has folders at most
    all_feeds = stored(kept.unionByName(fresh_feeds))
    sources = all_feeds.join(touched, all_feeds[partition].eqNullSafe(touched[partition]), "left_semi").select("relative_path").distinct()
    wanted = _among(F.col(partition), listed)
    made = stored(build(rows_of(sources).filter(wanted).drop("_file")))
    filled = {r[0] for r in made.select(partition).distinct().collect()}
    refresh_partitions(made, path, partition)
    for value in set(listed) - filled:
        _delete(spark, f"{path}/{_folder(spark, partition, value)}")
    now.write.mode("overwrite").parquet(f"{listings}/{VERSION}{version}/files")
    all_feeds.write.mode("overwrite").parquet(f"{listings}/{VERSION}{version}/feeds")
    # The marker comes last: it makes the new listing the valid one.
    _mark(spark, f"{listings}/{VERSION}{version}")
    for number in versions[:-1]:
        _delete(spark, f"{listings}/{VERSION}{number}")
    _delete(spark, pending)
    return Refresh(counts.get("added", 0), counts.get("changed", 0), counts.get("removed", 0), len(listed))


def _among(column: Column, values: Sequence) -> Column:
    found = column.isin([v for v in values if v is not None])
    return found | column.isNull() if None in values else found


def _folder(spark: SparkSession, partition: str, value) -> str:
    """The name Spark gives the folder of a partition."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return names.getPartitionPathString(partition, None if value is None else str(value))


def _mark(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()
