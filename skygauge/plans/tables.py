"""The standard tables, derived from the sensor log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.operators.features import build_features
from skygauge.operators.merge import combine, merge_weather
from skygauge.operators.repair import repair
from skygauge.schemas import LIVE_PAYLOAD, STATION
from skygauge.session import stage
from skygauge.sources.payloads import flatten_live
from skygauge.sources.sensor_log import (
    forecast_pollutants,
    historical_pollutants,
    read_events,
    station_of_sensor,
    weather_readings,
)


def raw_air_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical pollutants joined with weather."""
    return merge_weather(historical_pollutants(spark, sf_dir), weather_readings(spark, sf_dir))


def saved_air_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once: the repair reads it twice."""
    return stage(raw_air_quality(spark, sf_dir), "raw")


def raw_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical and forecast rows, one per station and hour."""
    return combine(raw_air_quality(spark, sf_dir), forecast_pollutants(spark, sf_dir))


def repaired_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(saved_air_quality(spark, sf_dir))


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as later steps read it: written once."""
    return stage(build_features(saved_air_quality(spark, sf_dir)), "featured")


def live_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the JSON text a station reading would land as.

    ``k`` plays the index; 0 stands for a failed reading and 1 for a missing index.
    """
    events = read_events(spark, sf_dir)
    keyed = events.select(
        station_of_sensor().alias(STATION),
        "ts",
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    reading = F.struct(F.col("value").alias("v"))
    payload = F.struct(
        F.when(F.col("k") == 0, "error").otherwise("ok").alias("status"),
        F.struct(
            F.when(F.col("k") == 1, "-").otherwise(F.col("k").cast("string")).alias("aqi"),
            F.struct(F.concat(F.lit("sensor "), F.col("user_id")).alias("name")).alias("city"),
            F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("s")).alias("time"),
            F.struct(reading.alias("pm25"), F.when(F.col("k") > 50, reading).alias("t")).alias(
                "iaqi"
            ),
        ).alias("data"),
    )
    return keyed.select(STATION, F.to_json(payload).alias("json"))


def live_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = live_payloads(spark, sf_dir).select(
        STATION, F.from_json("json", LIVE_PAYLOAD).alias("p")
    )
    return flatten_live(parsed.select(STATION, "p.*"))
