"""Intermediate tables in the shared folder, and column names that are free."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import scratch_dir


class Scratch:
    """Tables of one query under the folder named by ``spark.checkpoint.dir``.

    A written table ends the lineage and survives the loss of any executor. ``drop`` deletes one that
    no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count, self.paths = spark, scratch_dir(spark, label), 0, {}

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self.count:03d}-{name}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self.paths:
                _, path = self.paths.pop(id(table))
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where a column of ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
