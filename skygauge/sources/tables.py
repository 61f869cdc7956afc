"""Table scans and overwriting sinks (Parquet, CSV, JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.functions.numeric import nan_to_null
from skygauge.schemas import STATION, TIMESTAMP


def _clean(df: DataFrame) -> DataFrame:
    """NaN means missing in every source."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select([nan_to_null(df[c]).alias(c) if c in doubles else df[c] for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema (unreadable numbers become null)."""
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    reader = reader.option("timestampNTZFormat", "yyyy-MM-dd[ ]['T']HH:mm[:ss]")
    return _clean(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _clean(spark.read.parquet(path))


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None
) -> None:
    """Overwrite ``path``; rows are ordered in time inside each file.

    Without ``partition_by`` the rows keep the partitions they have. With it they are first
    brought together by that column and the year: one file per folder and year, and a
    dominant station still has a task per year.
    """
    if partition_by and TIMESTAMP in df.columns:
        df = df.repartition(partition_by, F.year(TIMESTAMP))
    if TIMESTAMP in df.columns:
        keys = [c for c in (STATION, TIMESTAMP) if c in df.columns]
        df = df.sortWithinPartitions(*keys)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
        )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.format(fmt).save(path)


def overwrite_if_any(df: DataFrame, path: str, **kwargs: str) -> bool:
    """Keep the old table when there is nothing new (a source was empty)."""
    if df.isEmpty():
        return False
    write_table(df, path, **kwargs)
    return True


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
