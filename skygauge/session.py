"""Session helper and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "skygauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    ``conf`` takes Spark keys with ``__`` in place of dots. The master is left to
    spark-submit unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a session on one machine without that setting (tests, a laptop) gets a folder of its own; on
    a cluster, executors would not see each other's files, so the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is None and not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = current or tempfile.mkdtemp(prefix="skygauge-")
        if current is None:
            spark.sparkContext.setCheckpointDir(shared)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, visible to every executor.

    All paths of an application are under ``<shared folder>/skygauge/<application id>``.
    """
    root = os.path.join(ensure_checkpoint_dir(spark), "skygauge", spark.sparkContext.applicationId)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    For a result that several later steps read: it is computed once, its lineage ends, the
    optimizer knows its size, and a lost executor costs one read instead of the whole chain.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything this application has staged. DataFrames read from it are lost."""
    root = os.path.join(ensure_checkpoint_dir(spark), "skygauge", spark.sparkContext.applicationId)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="skygauge-"), "skygauge")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "skygauge"))
    _shipped.add(context.applicationId)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out over all cores, for steps with little data but much work per row.

    A fixed number of partitions, as adaptive execution would pack small rows into a few
    tasks. Under dynamic allocation few cores may be up yet, so the configured number of
    shuffle partitions counts as well.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(spark.sparkContext.defaultParallelism, configured), *keys)
