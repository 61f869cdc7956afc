"""Joining, stacking and deduplicating raw series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.schemas import MEASUREMENTS, STATION, TIMESTAMP


def merge_weather(pollutants: DataFrame, weather: DataFrame) -> DataFrame:
    """Hours present in both tables, tagged as historical.

    No broadcast hint: either side grows with the data, and adaptive execution broadcasts
    only after it has measured one.
    """
    joined = pollutants.join(weather, [STATION, TIMESTAMP], "inner")
    return joined.withColumn("is_forecast", F.lit(False)).select(
        STATION, TIMESTAMP, *MEASUREMENTS, "is_forecast"
    )


def stack(historical: DataFrame, forecast: DataFrame) -> DataFrame:
    """Historical then forecast rows by name; columns one side lacks are null."""
    return historical.unionByName(forecast, allowMissingColumns=True)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (ties: the smallest row).

    An aggregate instead of a row number: copies of one key collapse before the shuffle,
    however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)
    first = df.groupBy(*keys).agg(F.min(rank).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])


def dedup_hours(df: DataFrame) -> DataFrame:
    """One row per station and hour; a historical row beats a forecast one."""
    return keep_first(df, [STATION, TIMESTAMP], [F.col("is_forecast")])


def combine(historical: DataFrame, forecast: DataFrame) -> DataFrame:
    """Stack and deduplicate. Order rows where they are written or shown."""
    return dedup_hours(stack(historical, forecast))


def in_time_order(df: DataFrame) -> DataFrame:
    return df.orderBy(STATION, TIMESTAMP)


def historical_only(df: DataFrame) -> DataFrame:
    """Drops forecast rows if the table tells them apart."""
    return df.filter(~F.col("is_forecast")) if "is_forecast" in df.columns else df


def trailing_range(
    df: DataFrame, as_of: dt.date, days: int = 365, by: str = TIMESTAMP
) -> DataFrame:
    """Rows from ``as_of - days`` up to the end of the day before ``as_of``.

    Plain bounds on the column, so they reach the Parquet scan.
    """
    start = F.lit(str(as_of - dt.timedelta(days=days))).cast("timestamp_ntz")
    end = F.lit(str(as_of)).cast("timestamp_ntz")
    return df.filter((F.col(by) >= start) & (F.col(by) < end))


def require_unique_hours(df: DataFrame) -> DataFrame:
    """Fails the job that reads it when a station has an hour twice.

    Positions would shift silently. Costs one aggregate; use it before features when the
    input did not pass ``dedup_hours``.
    """
    counted = df.groupBy(STATION, TIMESTAMP).agg(F.count("*").alias("_copies"))
    message = F.concat(F.lit("duplicate hour in station "), F.col(STATION))
    checked = counted.filter(
        F.when(F.col("_copies") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    )
    return df.join(checked.drop("_copies"), [STATION, TIMESTAMP], "left_semi")
