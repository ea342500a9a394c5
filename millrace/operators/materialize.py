"""Save results, read them back instead of computing them again, and grow or refresh them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from millrace.operators import keyfilter
from millrace.session import stored
from millrace.sinks.files import layout, write, write_by_key
from millrace.sources import files
from millrace.sources.custom import REGISTERED

Compute = Callable[[], DataFrame]
Target = tuple[str, str]  # (path, format)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its commit marker in ``path``.

    Refreshing single partitions leaves no marker; a first full write does.
    """
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def read_back(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Reopen a saved result with the types it was saved with; ``schema`` chooses others.

    ``options`` are those it was written with. CSV does not tell an empty text from NULL, and both
    come back as NULL, unless ``nullValue`` was given. A file of CSV is split over tasks unless texts with line
    breaks were saved in it; for files from elsewhere give ``multiLine`` where they have such texts.
    """
    stored_layout = layout(spark, path) if fmt in ("csv", "json") else None
    if stored_layout and schema is None:
        schema = StructType.fromJson(stored_layout["schema"])
    if fmt == "csv":
        breaks = bool(stored_layout and stored_layout["line_breaks"])
        return files.read_csv(spark, path, schema, **{"multiLine": breaks, **options})
    if fmt == "json":
        return files.read_json(spark, path, schema, **options)
    if fmt == "text":
        return files.read_text(spark, path, **options)
    if fmt == "matrix":
        return files.read_matrix(spark, path, **options)
    known = schema is not None and fmt not in REGISTERED  # a registered format has its own
    reader = spark.read.schema(schema) if known else spark.read
    return reader.options(**options).format(fmt).load(path)


def materialize(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options) -> DataFrame:
    """Save ``df`` and pass it on. What is passed on reads the saved files: ``df`` runs once."""
    schema = None if fmt in ("text", "matrix") else df.schema
    write(df, path, fmt, mode, **options)
    return read_back(df.sparkSession, path, fmt, schema, **options)


def materialize_many(outputs: Sequence[DataFrame], targets: Sequence[Target], shared: DataFrame | None = None):
    """Save several outputs, the first to the first target, and pass all of them on.

    ``shared``, a parent that the outputs have in common, is kept while they are written.
    """
    if len(outputs) != len(targets):
        raise ValueError(f"{len(outputs)} outputs for {len(targets)} targets")
    if shared is not None:
        shared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return tuple(materialize(df, path, fmt) for df, (path, fmt) in zip(outputs, targets))
    finally:
        if shared is not None:
            shared.unpersist()


def read_or_compute(
    spark: SparkSession,
    path: str,
    compute: Compute | None,
    fmt: str = "parquet",
    schema=None,
    done: Callable[[], bool] | None = None,
    full_refresh: bool = False,
    **options,
) -> DataFrame:
    """The saved result when there is one and it counts as done, else the computed and saved one.

    ``done`` replaces the check for the commit marker. ``full_refresh`` computes in any case.
    With ``compute=None`` a missing result is an error: the step upstream has not run.
    """
    finished = is_complete(spark, path)
    if not full_refresh and finished and (done is None or done()):
        return read_back(spark, path, fmt, schema, **options)
    if compute is None:
        if finished:
            return read_back(spark, path, fmt, schema, **options)
        raise ValueError(f"nothing is saved at {path} and the step that fills it was not run")
    result = compute()
    if result is None:
        raise ValueError(f"the step for {path} produced no output")
    return materialize(result, path, fmt, mode="overwrite", **options)


def fan_out(
    df: DataFrame,
    key: str,
    path: str,
    fmt: str = "parquet",
    done: Callable[[], bool] | None = None,
    full_refresh: bool = False,
    **options,
) -> str:
    """One folder per key, written unless that is done already; returns the path."""
    finished = is_complete(df.sparkSession, path)
    if full_refresh or not finished or (done is not None and not done()):
        write_by_key(df, key, path, fmt, mode="overwrite", **options)
    return path


def read_many(spark: SparkSession, targets: Mapping[str, Target], schemas: Mapping | None = None):
    """Reopen several saved outputs by name."""
    schemas = schemas or {}
    return {
        name: read_or_compute(spark, path, None, fmt, schemas.get(name)) for name, (path, fmt) in targets.items()
    }


def without_saved(source: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not saved yet. NULL keys match each other; no key is read twice."""
    present = saved.select(*(F.col(k).alias(f"_saved_{k}") for k in keys)).distinct()
    same = reduce(and_, (source[k].eqNullSafe(present[f"_saved_{k}"]) for k in keys))
    return source.join(present, same, "left_anti")


def append_missing(source: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Append one row for each key of ``source`` that the target does not hold yet; returns the target.

    Of the target only the keys are read, and of Parquet targets only in the files that may hold one of the source's: a range and a
    filter of each file's keys lie beside the data, see ``keyfilter``. Running it again adds nothing twice, whether or not the
    target has a commit marker. Of several rows of a key any one is added.
    """
    spark = source.sparkSession
    fresh = source.dropDuplicates(list(keys))
    if path_exists(spark, path):
        saved = read_back(spark, path, fmt, source.schema)
        if fmt == "parquet":
            fresh = stored(fresh)  # its keys are needed twice
            some = keyfilter.files_that_may_hold(saved, path, fresh, keys)
            saved = spark.read.schema(source.schema).parquet(*some) if some else saved.limit(0)
        fresh = without_saved(fresh, saved, keys)
    write(fresh, path, fmt, mode="append")
    result = read_back(spark, path, fmt, source.schema)
    if fmt == "parquet":
        keyfilter.learn(result, path, keys)
    return result


def refresh_partitions(source: DataFrame, path: str, partition: str) -> DataFrame:
    """Replace the partitions that occur in ``source`` and leave all others; returns the target."""
    (
        source.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    return source.sparkSession.read.schema(source.schema).parquet(path).select(*source.columns)
