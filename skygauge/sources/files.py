"""Small file operations in whatever store a path names, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _of(spark, path)
    return store.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    store, at = _of(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small new file; False if another writer has made it first."""
    store, at = _of(spark, path)
    try:
        out = store.create(at, False)
    except Exception as error:
        if store.exists(at):
            return False
        raise error
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def rename(spark: SparkSession, path: str, to: str) -> bool:
    store, at = _of(spark, path)
    return store.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to))


def read(spark: SparkSession, path: str) -> str:
    """All of a small file."""
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def delete(spark: SparkSession, path: str) -> None:
    store, at = _of(spark, path)
    store.delete(at, True)


def modified(spark: SparkSession, path: str) -> int:
    """Milliseconds of the last change."""
    store, at = _of(spark, path)
    return store.getFileStatus(at).getModificationTime()
