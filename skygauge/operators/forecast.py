"""Recursive multi-step forecast: every prediction feeds the next step.

Steps depend on each other, origins do not. One row per origin holds all the state it
needs, so origins are spread over the cluster and a task advances a whole Arrow batch of
them together, one vectorized prediction per step, without any shuffle in between.

Modes (the defaults reproduce the reference behaviour):

* ``calendar='carried'``: the day of week moves on every 24 steps and the month stays;
  ``'exact'``: both belong to the forecast hour.
* ``lags='origin'``: a lag that reaches back before the origin is the origin row's own lag;
  ``'exact'``: it is the observed value (needs ``with_recent``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.functions.aqi import BREAKPOINTS, OUT_OF_BAND, aqi_pm25, aqi_pm25_2012, category
from skygauge.functions.calendar import (
    RUSH_HOURS,
    WEEKEND_DAYS,
    cyclic_parts,
    plus_hours,
    rush_flag,
    weekend_flag,
)
from skygauge.functions.numeric import (
    EPSILON,
    interaction_parts,
    non_negative,
    positive_or_one,
    round_binary,
)
from skygauge.operators.features import positioned
from skygauge.operators.models import score
from skygauge.operators.scorers import Scorer, has_arrays, scorer_of
from skygauge.operators.series import in_chunk, latest_rows, overlapping_chunks, own_rows
from skygauge.schemas import (
    CARRIED,
    FEATURE_COLS,
    FORECAST,
    LAGS,
    POS_COLS,
    ROLLS,
    STATION,
    TARGET,
    TIMESTAMP,
)
from skygauge.session import ensure_checkpoint_dir, ship_package, spread

STEPS = 72
RECENT = "recent"
PREDICTIONS = "predictions"
STEPS_PER_CHECKPOINT = 12

ORIGIN_COLS = [*CARRIED, "hour", "day_of_week", "month", TARGET] + [f"pm2_5_lag{k}" for k in LAGS]


def with_recent(featured: DataFrame, rows: int = max(LAGS)) -> DataFrame:
    """Adds the last ``rows`` target values up to each row, oldest first (at most 48 here)."""
    given = featured.columns
    chunks = overlapping_chunks(positioned(featured), rows - 1)
    frame = in_chunk().rowsBetween(1 - rows, 0)
    recent = own_rows(chunks.withColumn(RECENT, F.collect_list(TARGET).over(frame)))
    return recent.select(*given, RECENT)


# -- batched form -----------------------------------------------------------------------


def _aqi(v: np.ndarray, standard: str) -> np.ndarray:
    out = np.full(v.shape, float(OUT_OF_BAND))
    for lo, hi, alo, ahi in BREAKPOINTS[standard, "pm2_5"]:
        inside = (v >= lo) & (v <= hi)
        out[inside] = np.rint((ahi - alo) / (hi - lo) * (v[inside] - lo) + alo)
    return out


def _calendar_arrays(batch: pd.DataFrame, step: int, calendar: str) -> dict[str, np.ndarray]:
    clock = batch["hour"].to_numpy() + step
    days = clock // 24 if calendar == "exact" else step // 24
    hour, dow = clock % 24, (batch["day_of_week"].to_numpy() + days) % 7
    month = batch["month"].to_numpy()
    if calendar == "exact":
        month = (batch[TIMESTAMP] + pd.Timedelta(hours=step)).dt.month.to_numpy()
    parts = {
        "hour": hour,
        "day_of_week": dow,
        "month": month,
        "is_weekend": np.isin(dow, WEEKEND_DAYS).astype(float),
        "is_rush_hour": np.isin(hour, RUSH_HOURS).astype(float),
    }
    for name, value, period in (("hour", hour, 24), ("month", month, 12), ("dow", dow, 7)):
        parts[f"{name}_sin"] = np.sin(2 * np.pi * value / period)
        parts[f"{name}_cos"] = np.cos(2 * np.pi * value / period)
    return parts


def _lag_array(
    batch: pd.DataFrame, series: np.ndarray, recent: np.ndarray | None, step: int, lag: int
) -> np.ndarray:
    if step >= lag:
        return series[:, step - lag]
    if recent is not None:
        return recent[:, recent.shape[1] - 1 - (lag - step)]
    return batch[f"pm2_5_lag{lag}"].to_numpy(dtype=float)


def advance(
    scorer: Scorer,
    batch: pd.DataFrame,
    steps: int = STEPS,
    calendar: str = "carried",
    lags: str = "origin",
    standard: str = "2012",
) -> np.ndarray:
    """Predictions (origins x steps) for a batch of origin rows."""
    carried = {c: batch[c].to_numpy(dtype=float) for c in CARRIED}
    recent = np.vstack(batch[RECENT].to_numpy()) if lags == "exact" else None
    pm10 = np.where(carried["pm10"] > 0, carried["pm10"], 1.0)
    series = np.empty((len(batch), steps + 1))
    series[:, 0] = batch[TARGET].to_numpy(dtype=float)
    for step in range(1, steps + 1):
        x = dict(carried, **_calendar_arrays(batch, step, calendar))
        for lag in LAGS:
            x[f"pm2_5_lag{lag}"] = _lag_array(batch, series, recent, step, lag)
            x[f"aqi_lag{lag}"] = _aqi(x[f"pm2_5_lag{lag}"], standard)
        for n in ROLLS:
            x[f"pm2_5_roll{n}"] = series[:, max(0, step - n) : step].mean(axis=1)
            x[f"aqi_roll{n}"] = _aqi(x[f"pm2_5_roll{n}"], standard)
        x["pm_ratio"] = x["pm2_5_lag1"] / (pm10 + EPSILON)
        x["wind_dispersion"] = x["wind_speed"] / (x["pm2_5_lag1"] + EPSILON)
        x["heat_humidity"] = x["temperature"] * x["humidity"] / 100
        matrix = np.column_stack([x[c] for c in FEATURE_COLS]).astype(float)
        series[:, step] = np.maximum(0.0, scorer.predict(matrix))
    return series[:, 1:]


def forecast_paths(
    scorer: Scorer,
    origins: DataFrame,
    steps: int = STEPS,
    keep: tuple[str, ...] = (),
    calendar: str = "carried",
    lags: str = "origin",
    standard: str = "2012",
) -> DataFrame:
    """One row per origin: station, timestamp, ``keep``, array of ``steps`` predictions.

    The origins are dealt out over all cores; the trees of the model are broadcast in groups.
    """
    ship_package(origins.sparkSession)
    needed = list(dict.fromkeys([STATION, TIMESTAMP, *keep, *ORIGIN_COLS]))
    if lags == "exact":
        needed.append(RECENT)
    rows = origins.select(*needed)
    out = rows.select(STATION, TIMESTAMP, *keep).withColumn(
        PREDICTIONS, F.lit(None).cast("array<double>")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = advance(scorer, batch, steps, calendar, lags, standard)
            result = batch[[STATION, TIMESTAMP, *keep]].copy()
            result[PREDICTIONS] = list(paths)
            yield result

    return spread(rows, STATION, TIMESTAMP).mapInPandas(run, out.schema)


# -- unrolled form ----------------------------------------------------------------------


def _unrolled_features(step: int) -> dict[str, Column]:
    """Model inputs of a step from the origin row and ``_series`` (origin value first)."""
    hour = F.pmod(F.col("hour") + step, F.lit(24))
    dow = F.pmod(F.col("day_of_week") + step // 24, F.lit(7))
    cols = {
        "hour": hour,
        "day_of_week": dow,
        "month": F.col("month"),
        "is_weekend": weekend_flag(dow),
        "is_rush_hour": rush_flag(hour),
        **cyclic_parts(hour, F.col("month"), dow),
    }
    for lag in LAGS:
        known = F.element_at("_series", -lag) if step >= lag else F.col(f"pm2_5_lag{lag}")
        cols[f"pm2_5_lag{lag}"] = known
        cols[f"aqi_lag{lag}"] = aqi_pm25_2012(known)
    for n in ROLLS:
        size = min(n, step)
        tail = F.slice("_series", -size, size)
        mean = F.aggregate(tail, F.lit(0.0), lambda total, v: total + v) / size
        cols[f"pm2_5_roll{n}"] = mean
        cols[f"aqi_roll{n}"] = aqi_pm25_2012(mean)
    weather = [F.col(c) for c in ("wind_speed", "temperature", "humidity")]
    last = F.element_at("_series", -1)
    cols.update(interaction_parts(last, positive_or_one(F.col("pm10")), *weather))
    return cols


def forecast_unrolled(
    model: PipelineModel, origins: DataFrame, steps: int = STEPS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``forecast_paths`` for any Spark model, of any size: ``steps`` chained transforms.

    The path is an array column; a checkpoint every few steps keeps the plan short.
    """
    ensure_checkpoint_dir(origins.sparkSession)
    state = origins.select(
        *dict.fromkeys([STATION, TIMESTAMP, *keep, *ORIGIN_COLS])
    ).withColumn("_series", F.array(F.col(TARGET)))
    for step in range(1, steps + 1):
        inputs = _unrolled_features(step)
        unchanged = [F.col(c) for c in FEATURE_COLS if c not in inputs]
        origin = F.struct(*[c for c in state.columns if c != "_series"]).alias("_origin")
        rows = state.select(
            origin, "_series", *unchanged, *[c.alias(name) for name, c in inputs.items()]
        )
        longer = F.array_append("_series", non_negative(F.col("prediction")))
        state = score(model, rows).select("_origin.*", longer.alias("_series"))
        if step % STEPS_PER_CHECKPOINT == 0 and step < steps:
            state = state.checkpoint()
    path = F.slice("_series", 2, steps)
    return state.select(STATION, TIMESTAMP, *keep, path.alias(PREDICTIONS))


# -- tables -----------------------------------------------------------------------------


def paths_for_model(
    model: PipelineModel,
    origins: DataFrame,
    steps: int = STEPS,
    keep: tuple[str, ...] = (),
    **options: str,
) -> DataFrame:
    """Batched for linear and tree models of any size, unrolled for other kinds.

    ``options`` (``calendar``, ``lags``, ``standard``) are those of ``forecast_paths``; the
    unrolled form has the defaults alone.
    """
    if has_arrays(model):
        return forecast_paths(scorer_of(origins.sparkSession, model), origins, steps, keep, **options)
    if options:
        raise ValueError(f"not for this kind of model: {sorted(options)}")
    return forecast_unrolled(model, origins, steps, keep)


def explode_paths(paths: DataFrame) -> DataFrame:
    """One row per origin and ``horizon_hour`` (from 1), with ``predicted``."""
    others = [c for c in paths.columns if c != PREDICTIONS]
    exploded = paths.select(*others, F.posexplode(PREDICTIONS).alias("_i", "predicted"))
    return exploded.withColumn("horizon_hour", F.col("_i") + 1).drop("_i")


def forecast_table(paths: DataFrame, standard: str = "2012") -> DataFrame:
    """Forecast rows with time, rounded value, index, category and horizon.

    The index is that of the unrounded prediction.
    """
    index = aqi_pm25 if standard == "2024" else aqi_pm25_2012
    rows = explode_paths(paths).withColumn("aqi_predicted", index(F.col("predicted")))
    return rows.select(
        STATION,
        plus_hours(F.col(TIMESTAMP), F.col("horizon_hour")).alias(TIMESTAMP),
        round_binary(F.col("predicted"), 2).alias("pm2_5_predicted"),
        "aqi_predicted",
        "horizon_hour",
        category(F.col("aqi_predicted")).alias("aqi_category"),
    ).select(FORECAST.names)


def latest_forecast(
    model: PipelineModel, featured: DataFrame, steps: int = STEPS, **options: str
) -> DataFrame:
    """Forecast from the last row of every station; ``options`` as in ``paths_for_model``."""
    rows = with_recent(featured) if options.get("lags") == "exact" else featured
    origins = latest_rows(rows.drop(*POS_COLS))
    paths = paths_for_model(model, origins, steps, **options)
    return forecast_table(paths, options.get("standard", "2012"))


def every_nth_hour(forecast: DataFrame, n: int = 12) -> DataFrame:
    return forecast.filter((F.col("horizon_hour") - 1) % n == 0)
