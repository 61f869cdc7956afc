"""Column lists and explicit schemas of every dataset."""

from __future__ import annotations

from pyspark.sql import types as T

STATION = "station"
TIMESTAMP = "timestamp"

POLLUTANTS = ["pm2_5", "pm10", "no2", "ozone", "co", "so2"]
WEATHER = ["temperature", "humidity", "wind_speed", "wind_dir", "pressure"]
MEASUREMENTS = POLLUTANTS + WEATHER

LAGS = [1, 3, 6, 12, 24, 48]
ROLLS = [3, 6, 12, 24]

CALENDAR = ["hour", "day_of_week", "month", "is_weekend", "is_rush_hour"]
CYCLIC = ["hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos"]
LAG_COLS = [f"{c}_lag{k}" for k in LAGS for c in ("pm2_5", "aqi")]
ROLL_COLS = [f"{c}_roll{n}" for n in ROLLS for c in ("pm2_5", "aqi")]
INTERACTIONS = ["pm_ratio", "wind_dispersion", "heat_humidity"]

TARGET = "pm2_5"
POS_COLS = ["pos", "n_rows"]

# The model input, in its fixed order (44 columns). Values carried forward unchanged by
# the recursive forecast come first.
CARRIED = ["no2", "ozone", "co", "so2", "pm10"] + WEATHER
FEATURE_COLS = CARRIED + CALENDAR + CYCLIC + LAG_COLS + ROLL_COLS + INTERACTIONS


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _hourly(names: list[str]) -> T.StructType:
    arrays = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]
    inner = T.StructType([T.StructField("time", T.ArrayType(T.StringType())), *arrays])
    return T.StructType([T.StructField("hourly", inner)])


# Payload field -> our column, for the parallel-array payloads.
POLLUTANT_FIELDS = {
    "pm2_5": "pm2_5",
    "pm10": "pm10",
    "nitrogen_dioxide": "no2",
    "ozone": "ozone",
    "carbon_monoxide": "co",
    "sulphur_dioxide": "so2",
}
WEATHER_FIELDS = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "wind_speed_10m": "wind_speed",
    "wind_direction_10m": "wind_dir",
    "surface_pressure": "pressure",
}

POLLUTANT_PAYLOAD = _hourly(list(POLLUTANT_FIELDS))
WEATHER_PAYLOAD = _hourly(list(WEATHER_FIELDS))

_VALUE = T.StructType([T.StructField("v", T.DoubleType())])
LIVE_INDICES = {
    "pm25": "pm25_live",
    "t": "temperature",
    "h": "humidity",
    "p": "pressure",
    "w": "wind_speed",
    "dew": "dew",
}
LIVE_PAYLOAD = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("aqi", T.StringType()),
                    T.StructField("city", T.StructType([T.StructField("name", T.StringType())])),
                    T.StructField("time", T.StructType([T.StructField("s", T.StringType())])),
                    T.StructField(
                        "iaqi", T.StructType([T.StructField(n, _VALUE) for n in LIVE_INDICES])
                    ),
                ]
            ),
        ),
    ]
)

_KEYS = [T.StructField(STATION, T.StringType()), T.StructField(TIMESTAMP, T.TimestampNTZType())]

RAW = T.StructType(_KEYS + _doubles(MEASUREMENTS) + [T.StructField("is_forecast", T.BooleanType())])

LIVE = T.StructType(
    _KEYS
    + [T.StructField("station_name", T.StringType()), T.StructField("aqi_live", T.IntegerType())]
    + _doubles(list(LIVE_INDICES.values()))
    + [T.StructField("source", T.StringType())]
)

FEATURED = T.StructType(
    _KEYS
    + _doubles(MEASUREMENTS)
    + [T.StructField("is_forecast", T.BooleanType()), T.StructField("aqi", T.IntegerType())]
    + [T.StructField(n, T.IntegerType()) for n in CALENDAR]
    + _doubles(CYCLIC)
    + [
        T.StructField(n, T.IntegerType() if n.startswith("aqi") else T.DoubleType())
        for n in LAG_COLS
    ]
    + _doubles(ROLL_COLS + INTERACTIONS)
)

FORECAST = T.StructType(
    _KEYS
    + [
        T.StructField("pm2_5_predicted", T.DoubleType()),
        T.StructField("aqi_predicted", T.DoubleType()),
        T.StructField("horizon_hour", T.IntegerType()),
        T.StructField("aqi_category", T.StringType()),
    ]
)

MODEL_METRICS = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("ordinal", T.IntegerType())]
    + _doubles(["mae", "rmse", "r2"])
)
HORIZON_METRICS = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("horizon_hours", T.IntegerType()),
        T.StructField("mae", T.DoubleType()),
    ]
)
IMPORTANCE = T.StructType(
    [T.StructField("feature", T.StringType()), T.StructField("mean_shap", T.DoubleType())]
)
