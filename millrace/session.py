"""Session building, the shared scratch folder, and table reading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Local runs only: one temporary root per application, made when the session names none.
_local_roots: dict[str, str] = {}


def build_session(app_name: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume. Existing settings win over these."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cpus = os.cpu_count() or 8
            builder = (
                builder.config("spark.sql.shuffle.partitions", str(min(8, cpus)))
                .config("spark.ui.enabled", "false")
                .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
                .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may go without: it gets a
    temporary folder of its own, which no other machine has to see.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        # One machine only: local-cluster has executors of its own.
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        root = _local_roots.get(sc.applicationId)
        if root is None:
            root = _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder name under the shared scratch folder."""
    return f"{scratch_root(spark)}/millrace/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """``df`` written to the shared scratch folder and read from there.

    Like a checkpoint it ends the lineage and survives the loss of any executor. As a Parquet table
    it also gives later steps its true size and only the columns they need.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The partition count that Spark itself will use for the next shuffle."""
    default = spark.conf.get("spark.sql.shuffle.partitions")
    if spark.conf.get("spark.sql.adaptive.enabled") == "true":
        return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", default))
    return int(default)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
