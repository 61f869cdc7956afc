"""Hourly station readings out of a raw event log.

The log has one row per sensor event ``(ts, user_id, event_type, value, props)``. Forty
neighbouring sensors form a station, so stations grow with the log. Means are taken over
whole cents: integer sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.functions.calendar import hour_start
from skygauge.schemas import MEASUREMENTS, POLLUTANTS, STATION, TIMESTAMP, WEATHER

SENSORS_PER_STATION = 40
EVENT_POLLUTANT = {
    "click": "pm2_5",
    "view": "pm10",
    "purchase": "no2",
    "signup": "ozone",
    "error": "co",
}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def station_of_sensor() -> Column:
    return F.concat(F.lit("S"), F.expr(f"user_id div {SENSORS_PER_STATION}"))


def station_events(events: DataFrame) -> DataFrame:
    """(station, timestamp, event_type, value, cents, k) of each event."""
    return events.select(
        station_of_sensor().alias(STATION),
        hour_start(F.col("ts")).alias(TIMESTAMP),
        "event_type",
        "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def _mean_of_cents(event_type: str) -> Column:
    cents = F.when(F.col("event_type") == event_type, F.col("cents"))
    return F.try_divide(F.sum(cents).cast("double"), F.lit(100.0) * F.count(cents))


def _pollutant_aggregates() -> list[Column]:
    means = [_mean_of_cents(event).alias(name) for event, name in EVENT_POLLUTANT.items()]
    return [*means, _mean_k().alias("so2")]


def _mean_k() -> Column:
    return F.sum("k").cast("double") / F.count("k")


def _weather_aggregates() -> list[Column]:
    return [
        F.min("value").alias("temperature"),
        _mean_k().alias("humidity"),
        F.count("*").cast("double").alias("wind_speed"),
        (F.sum("k") % 360).cast("double").alias("wind_dir"),
        F.max("value").alias("pressure"),
    ]


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven measurements per station and hour.

    Every aggregate has a partial form, so a sensor with a third of the log is reduced
    before the shuffle.
    """
    hours = station_events(read_events(spark, sf_dir)).groupBy(STATION, TIMESTAMP)
    wide = hours.agg(*_pollutant_aggregates(), *_weather_aggregates())
    return wide.select(STATION, TIMESTAMP, *MEASUREMENTS)


def pollutant_readings(spark: SparkSession, sf_dir: str, chosen=lambda events: events) -> DataFrame:
    """The pollutant half; ``chosen`` may narrow the events before they are summed."""
    hours = station_events(chosen(read_events(spark, sf_dir))).groupBy(STATION, TIMESTAMP)
    return hours.agg(*_pollutant_aggregates()).select(STATION, TIMESTAMP, *POLLUTANTS)


def weather_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather half; the station is off the air from 03:00 to 03:59."""
    hours = (
        station_events(read_events(spark, sf_dir))
        .filter(F.hour(TIMESTAMP) != 3)
        .groupBy(STATION, TIMESTAMP)
    )
    return hours.agg(*_weather_aggregates()).select(STATION, TIMESTAMP, *WEATHER)


def series_end(pollutants: DataFrame) -> DataFrame:
    """Per station the last hour before the forecast part starts (``cut``)."""
    return pollutants.groupBy(STATION).agg(
        (F.max(TIMESTAMP) - F.expr("interval 3 days")).alias("cut")
    )


def historical_pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pollutant_readings(spark, sf_dir)
    return rows.join(series_end(rows), STATION).filter(F.col(TIMESTAMP) <= F.col("cut")).drop("cut")


def forecast_pollutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one day before ``cut``: overlaps the historical part by a day."""
    rows = pollutant_readings(spark, sf_dir)
    after = F.col(TIMESTAMP) > F.col("cut") - F.expr("interval 1 day")
    joined = rows.join(series_end(rows), STATION).filter(after).drop("cut")
    return joined.withColumn("is_forecast", F.lit(True))
