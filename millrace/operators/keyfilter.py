"""Which files of a table may hold one of some keys: per file the range of the first key, and a static filter over all keys.

A filter is a bit table with ``BITS`` bits a key and ``PROBES`` places for each. It never misses a key it was made from; of other keys about
one in a thousand passes. Files never change, so an entry is made once, when the file is first met, and kept beside the data. A file
without an entry counts as one that may hold anything.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# What runs in Python workers travels with the job.
cloudpickle.register_pickle_by_value(sys.modules["millrace"])

BITS, PROBES = 16, 4
FOLDER = "_keys"
#: Hashes of so many incoming keys are sent to the tasks that probe the filters; more are compared by their range alone.
PROBED_KEYS = 1_000_000


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Bit positions of each hash, one array a probe, in a table of ``size`` bits."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) ^ (h >> np.uint64(17))) % np.uint64(size)


def static_filter(hashes: np.ndarray) -> bytes:
    size = max(64, BITS * len(hashes))
    table = np.zeros(size, bool)
    for places in _places(hashes, size):
        table[places] = True
    return np.int64(size).tobytes() + np.packbits(table).tobytes()


def any_held(table: bytes, hashes: np.ndarray) -> bool:
    """Whether a filter may hold one of the keys."""
    size, bits = int(np.frombuffer(table[:8], np.int64)[0]), np.frombuffer(table[8:], np.uint8)
    left = np.arange(len(hashes))
    for places in _places(hashes, size):
        at = places[left]
        left = left[(bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
        if not len(left):
            return False
    return True


def _hash(keys: Sequence[str]):
    return F.xxhash64(*(F.struct(F.col(k).isNull(), F.col(k)) for k in keys))


def _describe(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``file, least, most, nulls, filter`` of each file of ``table``; a file is what one task wrote, and one group here."""
    # Spark writes local names with one slash here and with three in the list of a table's files.
    rows = table.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("file"), _hash(keys).alias("h"), F.col(keys[0]).alias("k"))
    ranges = rows.groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count_if(F.col("k").isNull()).alias("nulls"))

    def built(group: pa.Table) -> pa.Table:
        filled = static_filter(group.column("h").to_numpy())
        return pa.table({"file": group.column("file")[:1], "filter": pa.array([filled], pa.binary())})

    filters = rows.select("file", "h").groupBy("file").applyInArrow(built, "file string, filter binary")
    return ranges.join(filters, "file")


def entries(spark: SparkSession, path: str) -> DataFrame | None:
    """What is known of the files under ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FOLDER}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{FOLDER}")


def learn(table: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Make the entries of the files of ``table`` that have none."""
    spark = table.sparkSession
    known = entries(spark, path)
    have = set() if known is None else {r.file for r in known.filter(F.col("keys") == ",".join(keys)).select("file").collect()}
    # The driver lists a table's files in any case; it compares their names.
    fresh = [f for f in table.inputFiles() if f not in have]
    if not fresh:
        return
    made = _describe(spark.read.schema(table.schema).parquet(*fresh), keys)
    made.withColumn("keys", F.lit(",".join(keys))).write.parquet(f"{path}/{FOLDER}/{uuid.uuid4().hex[:12]}")


def files_that_may_hold(table: DataFrame, path: str, incoming: DataFrame, keys: Sequence[str]) -> list[str]:
    """Files of ``table`` that may hold one of the keys of ``incoming``, and those of which nothing is known."""
    files, known = table.inputFiles(), entries(table.sparkSession, path)
    if known is None:
        return files
    known = known.filter(F.col("keys") == ",".join(keys))
    bounds = incoming.agg(F.min(keys[0]), F.max(keys[0]), F.count_if(F.col(keys[0]).isNull()), F.count(F.lit(1))).first()
    least, most, nulls, n = bounds
    meets = F.lit(False) if least is None else (F.col("least") <= F.lit(most)) & (F.col("most") >= F.lit(least))
    if nulls:
        meets = F.coalesce(meets, F.lit(False)) | (F.col("nulls") > 0)
    told = known.withColumn("meets", F.coalesce(meets, F.lit(False)))
    if n > PROBED_KEYS:
        judged = told.select("file", "meets")
    else:
        hashes = incoming.select(_hash(keys).alias("h")).toArrow().column(0).to_numpy()
        shared = table.sparkSession.sparkContext.broadcast(hashes)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [m and any_held(f, shared.value) for m, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_())], names=["file", "meets"])

        judged = told.select("file", "meets", "filter").mapInArrow(probe, "file string, meets boolean")
    verdict = {r.file: r.meets for r in judged.collect()}
    return [f for f in files if verdict.get(f, True)]
