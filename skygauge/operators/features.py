"""The feature table: index, calendar, lags, rolling means, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.functions.aqi import composite_aqi
from skygauge.functions.calendar import calendar_parts, cyclic_parts
from skygauge.functions.numeric import interaction_parts
from skygauge.operators.merge import historical_only, require_unique_hours
from skygauge.operators.repair import carry_forward, repair
from skygauge.session import stage
from skygauge.operators.series import (
    BUCKET_HOURS,
    CHUNK_ROWS,
    in_chunk,
    overlapping_chunks,
    own_rows,
    with_positions,
)
from skygauge.schemas import FEATURED, LAGS, POS_COLS, ROLLS, TIMESTAMP


def add_aqi(df: DataFrame, gap_policy: str = "reference") -> DataFrame:
    return df.withColumn(
        "aqi", composite_aqi(F.col("pm2_5"), F.col("pm10"), F.col("no2"), gap_policy)
    )


def add_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_parts(F.col(TIMESTAMP)))


def add_cyclic(df: DataFrame) -> DataFrame:
    return df.withColumns(cyclic_parts(F.col("hour"), F.col("month"), F.col("day_of_week")))


def add_history(
    df: DataFrame,
    cols: tuple[str, ...] = ("pm2_5", "aqi"),
    lags: list[int] = LAGS,
    rolls: list[int] = ROLLS,
    leak_safe: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Lags and full-window rolling means of ``cols``; ``df`` needs ``pos``.

    One shuffle on (station, chunk) serves all of them. ``leak_safe`` ends the rolling
    windows at the previous row.
    """
    last = -1 if leak_safe else 0
    halo = max([*lags, *[n - 1 - last for n in rolls]])
    w = in_chunk()
    lagged = [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for k in lags for c in cols]
    means = []
    for n in rolls:
        frame = w.rowsBetween(last - n + 1, last)
        for c in cols:
            full = F.count(c).over(frame) == n
            means.append(F.when(full, F.avg(c).over(frame)).alias(f"{c}_roll{n}"))
    chunks = overlapping_chunks(df, halo, max(chunk_rows, halo))
    return own_rows(chunks.select("*", *lagged, *means))


def add_interactions(df: DataFrame, leak_safe: bool = False) -> DataFrame:
    pm2_5 = F.col("pm2_5_lag1" if leak_safe else "pm2_5")
    rest = [F.col(c) for c in ("pm10", "wind_speed", "temperature", "humidity")]
    return df.withColumns(interaction_parts(pm2_5, *rest))


def positioned(df: DataFrame, bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    return df if "pos" in df.columns else with_positions(df, bucket_hours)


def build_features(
    raw: DataFrame,
    gap_policy: str = "reference",
    leak_safe: bool = False,
    train_share: float = 0.8,
    bucket_hours: int = BUCKET_HOURS,
    chunk_rows: int = CHUNK_ROWS,
    causal: bool = False,
) -> DataFrame:
    """Raw hourly series to the feature table; incomplete rows (the lag warm-up) drop out.

    A station with the same historical hour twice fails the job: see ``merge.dedup_hours``.

    ``leak_safe`` keeps the target out of its own features and fits medians and caps on the training part.
    ``causal`` goes further: no feature depends on a later row. Gaps take the last value before
    them, nothing is filled with medians or capped, and windows end before the current row.
    """
    fit_share = train_share if leak_safe else None
    given = require_unique_hours(historical_only(raw))
    if causal:
        leak_safe = True
        repaired = stage(carry_forward(given, bucket_hours=bucket_hours), "series")
    else:
        repaired = repair(given, bucket_hours, fit_share)
    indexed = add_aqi(repaired, gap_policy)
    history = add_history(indexed, leak_safe=leak_safe, chunk_rows=chunk_rows)
    full = add_interactions(add_cyclic(add_calendar(history)), leak_safe).drop(*POS_COLS)
    present = [c for c in FEATURED.names if c in full.columns]
    extra = [c for c in full.columns if c not in present]
    return full.select(*present, *extra).na.drop("any")


def aqi_stats(featured: DataFrame) -> DataFrame:
    return featured.agg(
        F.count("*").alias("n_rows"),
        F.min("aqi").alias("aqi_min"),
        F.max("aqi").alias("aqi_max"),
        F.avg("aqi").alias("aqi_mean"),
    )


def row_counts(combined: DataFrame) -> DataFrame:
    return combined.agg(
        F.count_if(~F.col("is_forecast")).alias("historical_rows"),
        F.count_if(F.col("is_forecast")).alias("forecast_rows"),
        F.count("*").alias("total_rows"),
    )
