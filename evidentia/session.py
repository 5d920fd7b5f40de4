"""Spark session defaults for local runs and tests.

On a cluster the session is built by the platform; the library only reads
settings from it. ``get_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE coalesces the shuffle partitions that a
# small input leaves nearly empty and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # After a shuffle the text stages fan rows out (modes x models x prompts)
    # and run regex work per row: keep partitions small enough that a small
    # shuffle output is not coalesced into one CPU-bound task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "evidentia") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder. Where it is unset, a local session (tests)
    gets a fresh scratch folder; on a cluster that is an error, since executors
    could not see a folder of the driver's machine.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="evidentia-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    For a small derived table that several branches of one plan read: without
    it each branch recomputes the whole lineage. A reliable checkpoint (not a
    local one) survives the loss of the executors that computed it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_dealt(spark: SparkSession) -> None:
    """Let a join take its inputs as they are dealt if both are dealt by the same part
    of its keys: rows with equal keys are in one task already. By default Spark shuffles
    them again by all keys of the join. Plans only, no results, depend on it; for data
    without a hot value in that part of the keys."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def stage_table(df, label: str):
    """Write a small derived table as Parquet into the shared folder and read it
    back: unlike a checkpoint its size is known to the planner, which can then
    broadcast it if it is small. Removed when the session's file systems close."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
