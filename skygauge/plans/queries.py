"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.functions import aqi
from skygauge.functions.calendar import calendar_parts, cyclic_parts
from skygauge.functions.numeric import lenient_double
from skygauge.operators import attribution, backtest, boosting, coalitions, evaluate, features, forecast, merge, models
from skygauge.operators.repair import carry_forward, interpolate, measured, median_fill, station_quantiles
from skygauge.operators.scorers import LinearScorer
from skygauge.operators.series import (
    LENGTH,
    POS,
    chronological_split,
    latest_rows,
    regularize,
    with_positions,
)
from skygauge.plans import reports, tables
from skygauge.schemas import (
    FEATURE_COLS,
    INTERACTIONS,
    LAGS,
    MEASUREMENTS,
    POLLUTANT_FIELDS,
    POLLUTANT_PAYLOAD,
    RAW,
    ROLLS,
    STATION,
    TIMESTAMP,
    WEATHER_FIELDS,
    WEATHER_PAYLOAD,
)
from skygauge.session import scratch_path, stage
from skygauge.sources import runs, sensor_log, snapshots
from skygauge.sources.payloads import flatten_hourly, read_forecast
from skygauge.sources.tables import read_csv, write_table
from skygauge.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

KEYS = [STATION, TIMESTAMP]

# Stand-ins for a fitted model wherever the result must be computable in SQL.
STUB_INTERCEPT = 3.0
STUB_COEFFICIENTS = {
    "pm2_5_lag1": 0.5,
    "pm2_5_lag24": 0.1,
    "pm2_5_roll3": 0.2,
    "pm2_5_roll24": 0.05,
    "aqi_lag6": 0.05,
    "aqi_roll12": 0.02,
    "hour_sin": 1.5,
    "dow_cos": 0.5,
    "is_rush_hour": 2.0,
    "is_weekend": -1.0,
    "pm_ratio": 0.001,
    "heat_humidity": 0.02,
    "wind_speed": -0.2,
}
STUB_BACKGROUND = 8
STUB_MODELS = {"Last Hour": "pm2_5_lag1", "Three Hours Ago": "pm2_5_lag3", "Day Mean": "pm2_5_roll24"}
AS_OF = dt.date(2024, 1, 20)


# Moves short decimals off the tie, where the last bit would decide the sixth place.
NUDGE = 1.7e-9


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Long floating chains to 6 places, for comparison across engines."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE, 6) for c in names})


def stub_scorer() -> LinearScorer:
    weights = np.array([STUB_COEFFICIENTS.get(f, 0.0) for f in FEATURE_COLS])
    return LinearScorer(weights, STUB_INTERCEPT)


# -- sources and merging ----------------------------------------------------------------


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_log.hourly_readings(spark, sf_dir)


def _daily_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, json): one parallel-array payload per station-day."""
    hours = sensor_log.pollutant_readings(spark, sf_dir)
    fields = [
        F.date_format(TIMESTAMP, "yyyy-MM-dd'T'HH:mm").alias("time"),
        *[F.col(new).alias(old) for old, new in POLLUTANT_FIELDS.items()],
    ]
    # At most 24 elements each.
    days = hours.groupBy(STATION, F.to_date(TIMESTAMP).alias("day")).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("rows")
    )
    arrays = [F.col(f"rows.{name}").alias(name) for name in ("time", *POLLUTANT_FIELDS)]
    return days.select(STATION, F.to_json(F.struct(F.struct(*arrays).alias("hourly"))).alias("json"))


def payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-days as payloads in JSON text, read back as rows."""
    payloads = _daily_payloads(spark, sf_dir)
    parsed = payloads.select(STATION, F.from_json("json", POLLUTANT_PAYLOAD).alias("p"))
    return flatten_hourly(parsed.select(STATION, "p.*"), POLLUTANT_FIELDS)


def landed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through files in a landing folder, one payload per line."""
    landing = scratch_path(spark, "landing")
    _daily_payloads(spark, sf_dir).write.partitionBy(STATION).text(landing)
    return read_forecast(spark, landing, multi_line=False)


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather station-days as payloads in JSON text, read back as rows."""
    fields = [
        F.date_format(TIMESTAMP, "yyyy-MM-dd'T'HH:mm").alias("time"),
        *[F.col(new).alias(old) for old, new in WEATHER_FIELDS.items()],
    ]
    # At most 24 elements each.
    days = sensor_log.weather_readings(spark, sf_dir).groupBy(STATION, F.to_date(TIMESTAMP).alias("day")).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("rows")
    )
    arrays = [F.col(f"rows.{name}").alias(name) for name in ("time", *WEATHER_FIELDS)]
    payloads = days.select(STATION, F.to_json(F.struct(F.struct(*arrays).alias("hourly"))).alias("json"))
    parsed = payloads.select(STATION, F.from_json("json", WEATHER_PAYLOAD).alias("p"))
    return flatten_hourly(parsed.select(STATION, "p.*"), WEATHER_FIELDS)


def historical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the features are built from: no forecast hour of the combined table."""
    return merge.historical_only(tables.raw_data(spark, sf_dir))


def snapshot_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is overwritten from itself, after an overwrite that fails and an empty one that is refused."""
    path = scratch_path(spark, "snapshots")
    snapshots.write_snapshot(tables.raw_air_quality(spark, sf_dir), path)
    saved = snapshots.read_snapshot(spark, path)
    broken = saved.withColumn("pm2_5", F.when(F.hour(TIMESTAMP) == 5, F.raise_error(F.lit("half-way")).cast("double")))
    try:
        snapshots.write_snapshot(broken, path)
    except Exception as error:
        if "half-way" not in str(error):
            raise
    snapshots.snapshot_if_any(saved.filter("station is null"), path)
    snapshots.write_snapshot(saved.withColumn("pm2_5", F.col("pm2_5") * 2), path)
    return snapshots.read_snapshot(spark, path)


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings written as CSV and read back with the declared schema."""
    path = scratch_path(spark, "csv")
    write_table(tables.raw_air_quality(spark, sf_dir), path, fmt="csv")
    return read_csv(spark, path, RAW)


def live_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.live_readings(spark, sf_dir)


def lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return sensor_log.read_events(spark, sf_dir).select(
        "event_id", lenient_double(text).alias("number")
    )


def merge_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.raw_air_quality(spark, sf_dir)


def union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.raw_data(spark, sf_dir)


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.row_counts(tables.raw_data(spark, sf_dir))


def trailing_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The bounds are whole hours, so they hold for events as well and reach the scan.
    in_range = lambda events: merge.trailing_range(events, AS_OF, 10, "ts")
    return sensor_log.pollutant_readings(spark, sf_dir, in_range)


def regular_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularize(sensor_log.pollutant_readings(spark, sf_dir))


# -- index ------------------------------------------------------------------------------


def _event_index(spark: SparkSession, sf_dir: str, value, index) -> DataFrame:
    events = sensor_log.read_events(spark, sf_dir)
    return events.select("event_id", value.alias("value")).withColumn("aqi", index(F.col("value")))


def aqi_pm25_2024(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_index(spark, sf_dir, F.col("value"), aqi.aqi_pm25)
    return rows.withColumn("aqi_no_gaps", aqi.aqi_pm25(F.col("value"), "truncate"))


def aqi_pm25_2012(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_index(spark, sf_dir, F.col("value"), aqi.aqi_pm25_2012)


def aqi_pm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_index(spark, sf_dir, F.col("value"), aqi.aqi_pm10)


def aqi_no2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_index(spark, sf_dir, aqi.no2_ppb(F.col("value")), aqi.aqi_no2)


def aqi_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_aqi(sensor_log.pollutant_readings(spark, sf_dir))
    return rows.select(*KEYS, "aqi", aqi.report_aqi(F.col("pm2_5")).alias("aqi_pm25_only"))


def aqi_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {e: p for e, p in sensor_log.EVENT_POLLUTANT.items() if ("2024", p) in aqi.BREAKPOINTS}
    pollutant = reduce(
        lambda acc, kv: acc.when(F.col("event_type") == kv[0], kv[1]),
        names.items(),
        F.when(F.lit(False), F.lit(None).cast("string")),
    )
    rows = sensor_log.read_events(spark, sf_dir).select(
        "event_id", pollutant.alias("pollutant"), "value"
    )
    return aqi.band_join(rows.filter(F.col("pollutant").isNotNull()))


def aqi_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours per station and category: the flagship query."""
    rows = features.add_aqi(sensor_log.hourly_readings(spark, sf_dir))
    labelled = rows.withColumn("category", aqi.category(F.col("aqi")))
    return labelled.groupBy(STATION, "category").agg(
        F.count("*").alias("hours"),
        F.min("aqi").alias("aqi_min"),
        F.max("aqi").alias("aqi_max"),
    )


# -- repair and features ----------------------------------------------------------------


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(interpolate(tables.saved_air_quality(spark, sf_dir)), *MEASUREMENTS)


def causal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry_forward(tables.saved_air_quality(spark, sf_dir))


def median_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = stage(interpolate(tables.saved_air_quality(spark, sf_dir)), "series")
    cols = measured(series)
    filled = median_fill(series, station_quantiles(series, cols), cols)
    return rounded(filled, *MEASUREMENTS)


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = stage(interpolate(tables.saved_air_quality(spark, sf_dir)), "series")
    return rounded(station_quantiles(series, measured(series)), "median", "lower", "upper")


def percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.repaired_series(spark, sf_dir), *MEASUREMENTS)


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sensor_log.read_events(spark, sf_dir)
    parts = calendar_parts(F.col("ts"))
    return events.select("event_id", *[c.alias(name) for name, c in parts.items()])


def cyclic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sensor_log.read_events(spark, sf_dir)
    parts = cyclic_parts(F.hour("ts"), F.month("ts"), F.weekday("ts"))
    rows = events.select("event_id", *[c.alias(name) for name, c in parts.items()])
    return rounded(rows, *parts)


def _history(spark: SparkSession, sf_dir: str, lags: list[int], rolls: list[int]) -> DataFrame:
    """Lags and means of the series as read, before any repair."""
    raw = with_positions(features.add_aqi(tables.raw_air_quality(spark, sf_dir)))
    given = raw.select(*KEYS, "pm2_5", "aqi", POS)
    return features.add_history(given, lags=lags, rolls=rolls).drop(POS)


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir, LAGS, [])
    index_lags = [c for c in rows.columns if c.startswith("aqi_lag")]
    return rows.withColumns({c: F.col(c).cast("double") for c in index_lags})


def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir, [], ROLLS)
    return rounded(rows, *[c for c in rows.columns if "_roll" in c])


def interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.add_interactions(tables.raw_air_quality(spark, sf_dir))
    return rounded(
        rows.select(*KEYS, *INTERACTIONS), *INTERACTIONS
    )


def featured_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.build_features(tables.saved_air_quality(spark, sf_dir))
    doubles = [name for name, kind in rows.dtypes if kind == "double"]
    return rounded(rows, *doubles)


def aqi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.aqi_stats(tables.featured(spark, sf_dir)), "aqi_mean")


# -- modelling --------------------------------------------------------------------------


def _positioned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chronological_split(tables.featured(spark, sf_dir))


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positioned_features(spark, sf_dir).select(*KEYS, POS, LENGTH, "is_train")


def _stub_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _positioned_features(spark, sf_dir)
    return rows.filter("not is_train")


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the last-hour stand-in per station."""
    scored = _stub_test_rows(spark, sf_dir).withColumn("prediction", F.col("pm2_5_lag1"))
    found = evaluate.regression_metrics(scored, by=(STATION,))
    return rounded(found, "mae", "rmse", "r2")


def _stub_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stand-ins scored in one pass: one long row per model and test row."""
    return _metrics_of_stubs(_stub_test_rows(spark, sf_dir))


def _metrics_of_stubs(rows: DataFrame) -> DataFrame:
    entries = [
        F.struct(F.lit(name).alias("model"), F.lit(i).alias("ordinal"), F.col(c).alias("prediction"))
        for i, (name, c) in enumerate(STUB_MODELS.items())
    ]
    long = rows.select("pm2_5", F.inline(F.array(*entries)))
    return evaluate.regression_metrics(long, by=("model", "ordinal")).drop("n")


def select_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = evaluate.select_model(_stub_metrics(spark, sf_dir))
    return rounded(best, "mae", "rmse", "r2")


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the stand-ins, the first one over every second test row; which is latest, and who won."""
    path = scratch_path(spark, "runs")
    rows = stage(_stub_test_rows(spark, sf_dir), "test rows")
    for k, (name, part) in enumerate((("half", rows.filter(F.col(POS) % 2 == 0)), ("whole", rows))):
        metrics = stage(_metrics_of_stubs(part), "metrics")
        runs.log_models(metrics, path, name, dt.datetime(2025, 1, 1 + k))
    latest = runs.latest_run(spark, path).select("run_id", "name", F.lit(True).alias("latest"))
    found = runs.history(spark, path).join(latest, ["run_id", "name"], "left")
    marked = found.select("run_id", "name", "ordinal", "mae", "rmse", "r2", "winner", F.coalesce("latest", F.lit(False)).alias("latest"))
    return rounded(marked, "mae", "rmse", "r2")


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = stage(_stub_metrics(spark, sf_dir), "metrics")
    return reports.model_comparison(metrics)


def backtest_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _positioned_features(spark, sf_dir)
    return backtest.backtest_origins(rows).select(*KEYS, POS, "reach")


def backtest_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtest of "as now" as the forecast of every hour ahead."""
    rows = _positioned_features(spark, sf_dir)
    hours = F.sequence(F.lit(1), F.lit(72))
    ahead = backtest.backtest_origins(rows).select(
        STATION, POS, "reach", F.col("pm2_5").alias("predicted"), F.explode(hours).alias("horizon_hour")
    )
    return rounded(backtest.horizon_mae(backtest.align_actuals(ahead, rows)), "mae")


def _stub_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = latest_rows(tables.featured(spark, sf_dir))
    return forecast.forecast_paths(stub_scorer(), origins)


def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.forecast_table(_stub_paths(spark, sf_dir))


def forecast_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.every_nth_hour(recursive_forecast(spark, sf_dir), 12)


def recursive_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _positioned_features(spark, sf_dir)
    origins = backtest.backtest_origins(rows)
    paths = forecast.forecast_paths(stub_scorer(), origins, keep=(POS, "reach"))
    aligned = backtest.align_actuals(forecast.explode_paths(paths), rows)
    return rounded(backtest.horizon_mae(aligned), "mae")


def linear_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.featured(spark, sf_dir)
    return rounded(attribution.linear_attribution(rows, STUB_COEFFICIENTS), "contribution")


class StubModel:
    """The stand-in as a model of no particular kind."""

    def transform(self, df: DataFrame) -> DataFrame:
        terms = (F.col(f) * F.lit(c) for f, c in STUB_COEFFICIENTS.items())
        return df.withColumn("prediction", reduce(lambda a, b: a + b, terms, F.lit(STUB_INTERCEPT)))


def coalition_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions to the stand-in's predictions, found from its predictions alone."""
    rows = tables.featured(spark, sf_dir)
    names = list(STUB_COEFFICIENTS)
    background = coalitions.background_rows(rows, names, STUB_BACKGROUND)
    found = coalitions.coalition_attribution(StubModel(), attribution.sample_rows(rows), background, names)
    return rounded(attribution.by_feature(found, names), "contribution")


def importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.featured(spark, sf_dir)
    found = attribution.importance(attribution.linear_attribution(rows, STUB_COEFFICIENTS))
    return rounded(attribution.top_features(found, 10), "mean_shap")


def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.sample_rows(tables.featured(spark, sf_dir)).select(*KEYS, "aqi")


# -- reports ----------------------------------------------------------------------------


def latest_per_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_rows(tables.raw_air_quality(spark, sf_dir))


def current_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.current_conditions(tables.featured(spark, sf_dir), tables.live_readings(spark, sf_dir))


def current_conditions_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.current_conditions(tables.featured(spark, sf_dir))


def history_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.history(reports.report_features(tables.featured(spark, sf_dir)))


def next_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.next_hours(recursive_forecast(spark, sf_dir))


def full_72h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.full_forecast(recursive_forecast(spark, sf_dir))


def forecast_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.forecast_bands(recursive_forecast(spark, sf_dir))


def pollutant_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pollutant_limits(tables.featured(spark, sf_dir))


def live_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of PM2.5 readings, each delivered twice."""
    schema = sensor_log.read_events(spark, sf_dir).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    events = source.parquet(sf_dir).filter(F.col("event_type") == "click")
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    readings = events.select(
        sensor_log.station_of_sensor().alias(STATION),
        F.col("ts").alias(TIMESTAMP),
        F.round(F.col("value") * 100).cast("long").alias("value"),
        F.lit(100).alias("weight"),
        F.col("user_id").alias(live.SENSOR),
        twice.alias("delivery"),
    )
    return live.drain(readings.drop("delivery"))


def boosting_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trees of two rounds over all events, without drawing rows or columns."""
    log = sensor_log.read_events(spark, sf_dir)
    rows = log.select(
        F.hour("ts").alias("hour"), F.weekday("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("user_id") % 40).alias("sensor"), F.length("event_type").alias("kind"),
        F.round(F.col("value") * 100).alias("cents"),
    )
    names = ["hour", "day", "k", "sensor", "kind"]
    settings = boosting.Settings(rounds=2, rate=0.5, depth=2, row_share=1.0, column_share=1.0)
    model = boosting.HistogramBoosting(settings, "cents").fit(rows, names)
    nodes = [
        (t, i, names[tree.feature[i]] if tree.feature[i] >= 0 else None, float(tree.threshold[i]) if tree.feature[i] >= 0 else None,
         float(tree.value[i]), int(tree.cover[i]))
        for t, tree in enumerate(model.trees)
        for i in range(len(tree.feature))
        if tree.cover[i] > 0
    ]
    made = spark.createDataFrame(nodes, "tree int, node int, feature string, threshold double, value double, rows long")
    # Gradients are whole multiples of about 5e-7 here.
    return made.withColumn("value", F.round("value", 4))


# -- fitted models: rows only -----------------------------------------------------------


def _fitted(spark: SparkSession, sf_dir: str, make) -> tuple:
    rows = tables.featured(spark, sf_dir)
    train, test = models.split_for_training(rows)
    return rows, models.fit(train, make(train)), test


def default_forest(train: DataFrame):
    return models.forest()


def default_boosting(train: DataFrame):
    return models.boosting()


def _trained(make) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, model, test = _fitted(spark, sf_dir, make)
        return evaluate.rounded_metrics(evaluate.regression_metrics(models.score(model, test)))

    return query


def train_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.featured(spark, sf_dir)
    return reports.model_comparison(models.train_and_compare(rows).metrics)


def forecast_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = _fitted(spark, sf_dir, default_boosting)
    return forecast.latest_forecast(model, rows)


def backtest_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = _fitted(spark, sf_dir, default_boosting)
    return backtest.recursive_backtest(model, rows)


def tree_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, _ = _fitted(spark, sf_dir, default_boosting)
    found = attribution.attribute(model, attribution.sample_rows(rows))
    return attribution.ranked(attribution.importance(found))


QUERIES: dict[str, Query] = {
    "hourly_readings": hourly_readings,
    "payload_flatten": payload_flatten,
    "landed_payloads": landed_payloads,
    "weather_payloads": weather_payloads,
    "historical_rows": historical_rows,
    "snapshot_overwrite": snapshot_overwrite,
    "csv_scan": csv_scan,
    "live_readings": live_readings,
    "lenient_cast": lenient_cast,
    "merge_weather": merge_weather,
    "union_dedup": union_dedup,
    "row_counts": row_counts,
    "trailing_range": trailing_range,
    "regular_hours": regular_hours,
    "aqi_pm25_2024": aqi_pm25_2024,
    "aqi_pm25_2012": aqi_pm25_2012,
    "aqi_pm10": aqi_pm10,
    "aqi_no2": aqi_no2,
    "aqi_composite": aqi_composite,
    "aqi_band_join": aqi_band_join,
    "aqi_category": aqi_category,
    "interpolate": interpolated,
    "causal_series": causal_series,
    "median_fill": median_filled,
    "station_quantiles": quantiles,
    "percentile_clip": percentile_clip,
    "calendar_features": calendar_features,
    "cyclic_features": cyclic_features,
    "lag_features": lag_features,
    "rolling_features": rolling_features,
    "interaction_features": interaction_features,
    "featured_table": featured_table,
    "aqi_stats": aqi_stats,
    "chrono_split": chrono_split,
    "regression_metrics": regression_metrics,
    "select_model": select_model,
    "model_comparison": model_comparison,
    "metric_history": metric_history,
    "backtest_origins": backtest_origins,
    "backtest_mae": backtest_mae,
    "recursive_forecast": recursive_forecast,
    "forecast_sample": forecast_sample,
    "recursive_backtest": recursive_backtest,
    "linear_attribution": linear_attribution,
    "coalition_shap": coalition_shap,
    "boosting_rounds": boosting_rounds,
    "importance_topk": importance_topk,
    "sampled_rows": sampled_rows,
    "latest_per_station": latest_per_station,
    "current_conditions": current_conditions,
    "current_conditions_model": current_conditions_model,
    "history_7d": history_7d,
    "next_24h": next_24h,
    "full_72h": full_72h,
    "forecast_bands": forecast_bands,
    "pollutant_limits": pollutant_limits,
    "live_stream": live_stream,
    "train_ridge": _trained(models.ridge),
    "train_forest": _trained(default_forest),
    "train_boosting": _trained(default_boosting),
    "train_compare": train_compare,
    "forecast_boosting": forecast_boosting,
    "backtest_boosting": backtest_boosting,
    "tree_shap": tree_shap,
}
