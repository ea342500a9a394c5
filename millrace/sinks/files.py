"""File sinks: CSV, text, JSON, numeric matrices, and one folder per key."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

from millrace.sources.custom import REGISTERED
from millrace.sources.files import CSV_OPTIONS, TIMESTAMP_OPTIONS

FORMATS = ("parquet", "orc", "csv", "json", "text", "matrix")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options) -> str:
    """Write ``df`` and return its path. ``options`` go to the writer as they are."""
    if fmt in REGISTERED:
        return _write_custom(df, path, fmt, mode, options)
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join([*FORMATS, *sorted(REGISTERED)])}")
    if fmt == "matrix":
        df, fmt = _matrix_lines(df), "text"
    if fmt not in ("csv", "json"):
        df.write.mode(mode).options(**options).format(fmt).save(path)
        return path
    seen, texts = Observation(), [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    broken = reduce(or_, (F.coalesce(F.col(f"`{c}`").rlike("[\\r\\n]"), F.lit(False)) for c in texts), F.lit(False))
    observed = df.observe(seen, F.coalesce(F.max(broken), F.lit(False)).alias("line_breaks"))
    observed.write.mode(mode).options(**{**_spelling(fmt), **options}).format(fmt).save(path)
    before = layout(df.sparkSession, path) if mode == "append" else None
    breaks = seen.get["line_breaks"] or bool(before and before["line_breaks"])
    _save_layout(df.sparkSession, path, {"schema": df.schema.jsonValue(), "line_breaks": breaks})
    return path


def _write_custom(df: DataFrame, path: str, fmt: str, mode: str, options: dict) -> str:
    """A format of ``register_format``, which itself knows only appending and overwriting."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = mode not in ("append", "overwrite") and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    if there and mode == "ignore":
        return path
    if there:
        raise ValueError(f"{path} exists already")
    df.write.mode(mode if mode == "overwrite" else "append").options(**options).format(fmt).save(path)
    return path


# Readers pass over names with an underscore.
LAYOUT = "_layout.json"


def _layout_file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"), LAYOUT)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _save_layout(spark: SparkSession, path: str, content: dict) -> None:
    fs, place = _layout_file(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(json.dumps(content).encode("utf-8")))
    finally:
        out.close()


def layout(spark: SparkSession, path: str) -> dict | None:
    """Schema of a text format, and whether a text has line breaks, as stored beside the data by ``write``."""
    fs, place = _layout_file(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _spelling(fmt: str) -> dict[str, str]:
    return {"csv": {**CSV_OPTIONS, **TIMESTAMP_OPTIONS}, "json": TIMESTAMP_OPTIONS}.get(fmt, {})


def _matrix_lines(df: DataFrame) -> DataFrame:
    if len(df.columns) != 1 or not isinstance(df.schema[0].dataType, ArrayType):
        raise ValueError("a matrix is one column of arrays")
    if not isinstance(df.schema[0].dataType.elementType, NumericType):
        raise ValueError("matrix elements must be numbers")
    # Fixed value: the number format of a text matrix.
    line = F.array_join(F.transform(df.columns[0], lambda x: F.format_string("%.18e", x.cast("double"))), " ")
    return df.select(line.alias("value"))


def write_by_key(
    df: DataFrame, key: str, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options
) -> str:
    """Fan out to one folder per value of ``key``; returns the path, not the data.

    The rebalance hint gives each key its own files and lets adaptive execution split a key that
    holds much of the data over several tasks. A NULL key fails the write.
    """
    if key not in df.columns or not isinstance(df.schema[key].dataType, StringType):
        raise ValueError(f"the fan-out key {key!r} must be a string column")
    keyed = df.withColumn(key, _required(F.col(key), f"NULL in the fan-out key {key}")).hint("rebalance", key)
    keyed.write.mode(mode).options(**{**_spelling(fmt), **options}).partitionBy(key).format(fmt).save(path)
    return path


def _required(column: Column, message: str) -> Column:
    return F.coalesce(column, F.raise_error(F.lit(message)).cast("string"))
