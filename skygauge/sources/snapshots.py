"""Tables that are overwritten as a whole, in one step.

A version's rows are written to a folder of its own, and the version is there once an empty file with its number and the
folder's name is. Making that file is the only step a reader can see, so

* a job that fails half-way leaves the table as it was,
* a job may overwrite the table it reads,
* readers of an older version keep it until ``vacuum`` removes it,
* of two writers at the same time one comes last, and its version is whole.

``<path>/data/<folder>/..`` holds rows, ``<path>/commits/<number>.<folder>`` the versions.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skygauge.sources import files
from skygauge.sources.tables import read_csv, read_parquet, write_table

KEPT_VERSIONS = 2
# Folders without a version that are younger than this may belong to a job that still runs.
GRACE_HOURS = 24.0


@dataclass(frozen=True, order=True)
class Version:
    number: int
    folder: str

    @property
    def file(self) -> str:
        return f"{self.number:012d}.{self.folder}"


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All versions that are there, oldest first."""
    found = []
    for name in files.names(spark, f"{path}/commits"):
        number, _, folder = name.partition(".")
        if number.isdigit() and folder:
            found.append(Version(int(number), folder))
    return sorted(found)


def current(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The latest version, or the one asked for."""
    found = [v for v in versions(spark, path) if number in (None, v.number)]
    return found[-1] if found else None


def folder_of(path: str, version: Version) -> str:
    """Where any Spark reader finds a version's rows."""
    return f"{path}/data/{version.folder}"


def write_snapshot(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: str | None = None,
    keep: int | None = KEPT_VERSIONS,
    number: int | None = None,
) -> Version:
    """Makes ``df`` the table's rows. ``keep`` versions stay, all if None.

    ``number`` names the version; writing it again replaces it.
    """
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    write_table(df, f"{path}/data/{folder}", fmt, partition_by)
    latest = current(spark, path)
    version = Version((latest.number + 1 if latest else 0) if number is None else number, folder)
    replaced = [v for v in versions(spark, path) if v.number == version.number] if number is not None else []
    if not files.create(spark, f"{path}/commits/{version.file}", ""):
        raise OSError(f"version {version.file} is there already")
    for old in replaced:
        files.delete(spark, f"{path}/commits/{old.file}")
    if keep is not None:
        vacuum(spark, path, keep)
    return version


def snapshot_if_any(df: DataFrame, path: str, **kwargs) -> Version | None:
    """Keep the old version when there is nothing new (a source was empty)."""
    return None if df.isEmpty() else write_snapshot(df, path, **kwargs)


def read_snapshot(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, number: int | None = None
) -> DataFrame:
    """The latest version, or the one asked for. ``schema`` is that of a CSV table."""
    version = current(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"no version {'' if number is None else number} of {path}")
    folder = folder_of(path, version)
    return read_csv(spark, folder, schema) if fmt == "csv" else read_parquet(spark, folder)


def vacuum(spark: SparkSession, path: str, keep: int = KEPT_VERSIONS, grace_hours: float = GRACE_HOURS) -> list[str]:
    """Removes all but the last ``keep`` versions, and folders that never became one.

    A version goes before its rows do, so no reader finds a version without rows.
    """
    if keep < 1:
        raise ValueError("the current version stays")
    found = versions(spark, path)
    for old in found[:-keep]:
        files.delete(spark, f"{path}/commits/{old.file}")
    kept = {v.folder for v in found[-keep:]}
    dropped = {v.folder for v in found[:-keep]}
    before = 1000 * (time.time() - 3600 * grace_hours)
    gone = []
    for folder in files.names(spark, f"{path}/data"):
        at = f"{path}/data/{folder}"
        if folder not in kept and (folder in dropped or files.modified(spark, at) < before):
            files.delete(spark, at)
            gone.append(folder)
    return gone
