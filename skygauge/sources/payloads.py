"""Landed JSON payloads as tables.

Landing folders are laid out ``<root>/station=<id>/*.json``; Spark discovers the station from
the folder name and prunes on it. A file holds one payload object, or one per line where
``multi_line`` is off (which lets Spark split large files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.functions.calendar import parse_iso, parse_timestamp
from skygauge.functions.numeric import nan_to_null
from skygauge.schemas import (
    LIVE,
    LIVE_INDICES,
    LIVE_PAYLOAD,
    POLLUTANT_FIELDS,
    POLLUTANT_PAYLOAD,
    STATION,
    TIMESTAMP,
    WEATHER_FIELDS,
    WEATHER_PAYLOAD,
)


def with_station(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(STATION, T.StringType())])


def _read(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    return spark.read.schema(with_station(schema)).json(path, multiLine=multi_line)


def flatten_hourly(payloads: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Parallel arrays under ``hourly`` to rows, zipped by position and renamed.

    A payload without ``hourly`` gives no rows.
    """
    arrays = [F.col("hourly.time").alias("time")] + [F.col(f"hourly.{f}").alias(f) for f in fields]
    rows = payloads.select(STATION, *arrays).select(
        STATION, F.inline(F.arrays_zip("time", *fields))
    )
    return rows.select(
        STATION,
        parse_iso(F.col("time")).alias(TIMESTAMP),
        *[nan_to_null(F.col(old)).alias(new) for old, new in fields.items()],
    )


def read_pollutants(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return flatten_hourly(_read(spark, path, POLLUTANT_PAYLOAD, multi_line), POLLUTANT_FIELDS)


def read_weather(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return flatten_hourly(_read(spark, path, WEATHER_PAYLOAD, multi_line), WEATHER_FIELDS)


def read_forecast(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Forecast pollutants, tagged ``is_forecast``."""
    return read_pollutants(spark, path, multi_line).withColumn("is_forecast", F.lit(True))


def flatten_live(payloads: DataFrame, source: str = "Ground Station") -> DataFrame:
    """Usable live readings.

    Dropped: a status other than ``ok``, a non-integer index, no readings, no station name,
    an unreadable time. A missing, null or zero number becomes 0.0.
    """
    numbers = [
        F.coalesce(F.col(f"data.iaqi.{field}.v"), F.lit(0.0)).alias(name)
        for field, name in LIVE_INDICES.items()
    ]
    readings = payloads.filter((F.col("status") == "ok") & F.col("data.iaqi").isNotNull()).select(
        STATION,
        parse_timestamp(F.col("data.time.s")).alias(TIMESTAMP),
        F.col("data.city.name").alias("station_name"),
        F.col("data.aqi").try_cast("int").alias("aqi_live"),
        *numbers,
        F.lit(source).alias("source"),
    )
    return readings.dropna(subset=[TIMESTAMP, "station_name", "aqi_live"]).select(LIVE.names)


def read_live(spark: SparkSession, path: str, source: str = "Ground Station") -> DataFrame:
    return flatten_live(_read(spark, path, LIVE_PAYLOAD), source)


def stream_live(
    spark: SparkSession, path: str, source: str = "Ground Station", max_files: int = 1000
) -> DataFrame:
    """The same landing folder as a stream of files; ``max_files`` only sizes its batches."""
    raw = (
        spark.readStream.schema(with_station(LIVE_PAYLOAD))
        .option("multiLine", True)
        .option("maxFilesPerTrigger", max_files)
        .json(path)
    )
    return flatten_live(raw, source)
