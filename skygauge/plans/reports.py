"""Report tables over the saved feature, forecast, live and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.functions.aqi import LIMITS, advice, colour, report_aqi, short_category
from skygauge.functions.calendar import horizon_text, long_clock, weekday_clock
from skygauge.functions.numeric import half_even, lenient_double, truncated_int, zero_if_null
from skygauge.operators.evaluate import rounded_metrics, select_model
from skygauge.operators.series import latest_rows, trailing_days
from skygauge.schemas import MEASUREMENTS, STATION, TIMESTAMP

LIVE_SOURCE = "Ground Station"
MODEL_SOURCE = "Model"

# Upper bounds of the shaded bands behind the forecast; above the last one there is none.
FORECAST_BANDS = [
    (0.0, 50.0, "Good"),
    (50.0, 100.0, "Moderate"),
    (100.0, 150.0, "Unhealthy-S"),
    (150.0, 200.0, "Unhealthy"),
]


def report_features(featured: DataFrame) -> DataFrame:
    """Features as the reports read them: lenient numbers, ``aqi`` from PM2.5 alone."""
    numbers = {c: lenient_double(F.col(c)) for c in MEASUREMENTS if c in featured.columns}
    return featured.withColumns(numbers).withColumn("aqi", report_aqi(F.col("pm2_5")))


def report_forecast(forecast: DataFrame) -> DataFrame:
    numbers = ("aqi_predicted", "pm2_5_predicted")
    return forecast.withColumns({c: lenient_double(F.col(c)) for c in numbers})


def shown(value: Column) -> Column:
    """One decimal; a missing value shows as 0."""
    return half_even(zero_if_null(value), 1)


def current_conditions(featured: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Per station the live reading if there is one, else the latest feature row.

    A station with a live reading alone has a row as well.

    PM10 is not part of a live reading and always comes from the feature row.
    """
    model = latest_rows(featured)
    picks = {"aqi": report_aqi(F.col("pm2_5")), "pm2_5": F.col("pm2_5")}
    same = ("temperature", "humidity", "wind_speed", "pressure")
    if live is None:
        joined = model.withColumn("_live", F.lit(False))
        value = {**picks, **{c: F.col(c) for c in same}}
    else:
        # Of readings with the same time, the largest row counts.
        newest = F.struct(TIMESTAMP, "aqi_live", "station_name", "pm25_live", *same)
        last = live.groupBy(STATION).agg(F.max(newest).alias("_row")).select(STATION, "_row.*").select(
            STATION,
            F.lit(True).alias("_live"),
            F.col("aqi_live").alias("l_aqi"),
            F.col("pm25_live").alias("l_pm2_5"),
            *[F.col(c).alias(f"l_{c}") for c in same],
        )
        joined = model.join(last, STATION, "full")
        value = {
            name: F.when(F.col("_live"), F.col(f"l_{name}")).otherwise(
                picks.get(name, F.col(name))
            )
            for name in ("aqi", "pm2_5", *same)
        }
    aqi = truncated_int(value["aqi"])
    return joined.select(
        STATION,
        aqi.alias("aqi"),
        shown(value["pm2_5"]).alias("pm2_5"),
        shown(F.col("pm10")).alias("pm10"),
        shown(value["temperature"]).alias("temperature"),
        truncated_int(zero_if_null(value["humidity"])).alias("humidity"),
        shown(value["wind_speed"]).alias("wind_speed"),
        truncated_int(zero_if_null(value["pressure"])).alias("pressure"),
        short_category(aqi).alias("category"),
        advice(aqi).alias("advice"),
        colour(aqi).alias("colour"),
        F.when(F.col("_live"), F.lit(LIVE_SOURCE)).otherwise(F.lit(MODEL_SOURCE)).alias("source"),
    )


def history(featured: DataFrame, days: int = 7) -> DataFrame:
    """PM2.5-only index of the last days of every station, last bound included."""
    rows = trailing_days(featured.select(STATION, TIMESTAMP, "pm2_5"), days)
    return rows.select(STATION, TIMESTAMP, report_aqi(F.col("pm2_5")).alias("aqi"))


def _table(forecast: DataFrame, time: Column, *extra: Column) -> DataFrame:
    return report_forecast(forecast).select(
        STATION,
        time.alias("time"),
        truncated_int(F.col("aqi_predicted")).alias("aqi"),
        half_even(F.col("pm2_5_predicted"), 1).alias("pm2_5"),
        F.col("aqi_category").alias("category"),
        *extra,
    )


def next_hours(forecast: DataFrame, hours: int = 24) -> DataFrame:
    return _table(forecast.filter(F.col("horizon_hour") <= hours), weekday_clock(F.col(TIMESTAMP)))


def full_forecast(forecast: DataFrame) -> DataFrame:
    horizon = horizon_text(F.col("horizon_hour")).alias("horizon")
    return _table(forecast, long_clock(F.col(TIMESTAMP)), horizon)


def forecast_bands(forecast: DataFrame) -> DataFrame:
    """The forecast series with the band its index lies in (the lower one on a bound)."""
    aqi = F.col("aqi_predicted")
    fields = {"band_low": 0, "band_high": 1, "band": 2}
    none = {"band_low": "double", "band_high": "double", "band": "string"}

    def pick(name: str) -> Column:
        chain = F.when(aqi.isNull(), F.lit(None).cast(none[name]))
        for band in FORECAST_BANDS:
            chain = chain.when(aqi <= band[1], F.lit(band[fields[name]]))
        return chain.alias(name)

    return report_forecast(forecast).select(
        STATION, TIMESTAMP, "horizon_hour", "aqi_predicted", "pm2_5_predicted", *map(pick, fields)
    )


def pollutant_limits(featured: DataFrame) -> DataFrame:
    """Latest value of five pollutants beside its guideline limit."""
    names = [name for name, _ in LIMITS]
    latest = latest_rows(featured.select(STATION, TIMESTAMP, *names))
    long = latest.unpivot([STATION], names, "pollutant", "value").withColumn(
        "value", shown(F.col("value"))
    )
    limits = featured.sparkSession.createDataFrame(LIMITS, "pollutant string, limit double")
    return long.join(F.broadcast(limits), "pollutant").select(
        STATION, "pollutant", "value", "limit", (F.col("value") > F.col("limit")).alias("exceeds")
    )


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Rounded metrics in model order with the winner marked (one row per model)."""
    best = select_model(metrics).select(F.col("model").alias("_best"))
    joined = rounded_metrics(metrics).join(
        F.broadcast(best), F.col("model") == F.col("_best"), "left"
    )
    return joined.select(
        "model", "ordinal", "mae", "rmse", "r2", F.col("_best").isNotNull().alias("selected")
    )
