import datetime as dt

import pytest
from pyspark.sql import functions as F

from skygauge.operators.features import build_features
from skygauge.plans import reports
from skygauge.schemas import FORECAST, LIVE
from skygauge.session import stage

from conftest import raw_frame, to_spark


@pytest.fixture(scope="module")
def featured(spark):
    return stage(build_features(to_spark(spark, raw_frame(250, stations=2))), "test-featured")


def test_conditions_prefer_the_live_reading(spark, featured):
    t = dt.datetime(2025, 3, 9)
    rows = [
        ("S0", t, "old", 10, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "x"),
        ("S0", t + dt.timedelta(hours=1), "new", 160, 72.26, 30.25, 55.9, 0.0, 2.35, 3.0, "x"),
    ]
    rows = [(s, ts, n, a, pm, te, hu, pr, wi, de, so) for s, ts, n, a, pm, te, hu, pr, wi, de, so in rows]
    live = spark.createDataFrame(rows, LIVE)
    found = {r.station: r for r in reports.current_conditions(featured, live).collect()}
    one, other = found["S0"], found["S1"]
    assert (one.aqi, one.pm2_5, one.category, one.source) == (160, 72.3, "Unhealthy", "Ground Station")
    assert one.pressure == 55 or one.humidity == 55
    assert other.source == "Model"
    model = {r.station: r for r in reports.current_conditions(featured).collect()}
    assert other == model["S1"]
    assert model["S0"].pm10 == one.pm10


def test_missing_values_show_as_zero(spark, featured):
    hidden = featured.withColumn("pm2_5", F.lit(None).cast("double")).withColumn("temperature", F.lit(None).cast("double"))
    row = reports.current_conditions(hidden).first()
    assert (row.aqi, row.pm2_5, row.temperature, row.category) == (0, 0.0, 0.0, "Good")


def test_history(featured):
    rows = reports.history(featured).toPandas()
    assert (rows.groupby("station").size() == 169).all()


def forecast(spark):
    start = dt.datetime(2025, 3, 3)
    rows = [
        ("A", start + dt.timedelta(hours=h), 10.25 + h, float(40 + 5 * h), h, "Good") for h in range(1, 73)
    ]
    return spark.createDataFrame(rows, FORECAST)


def test_forecast_tables(spark):
    day = reports.next_hours(forecast(spark)).collect()
    assert len(day) == 24 and day[0].time == "Mon 01:00" and day[0].pm2_5 == 11.2
    full = reports.full_forecast(forecast(spark)).collect()
    assert len(full) == 72 and full[71].horizon == "72h ahead"
    assert full[0].time == "Mar 03, 2025  01:00"


def test_bands(spark):
    rows = {r.aqi_predicted: (r.band_low, r.band) for r in reports.forecast_bands(forecast(spark)).collect()}
    assert rows[50.0] == (0, "Good") and rows[55.0] == (50, "Moderate")
    assert rows[200.0] == (150, "Unhealthy") and rows[205.0] == (None, None)


def test_limits(spark, featured):
    rows = reports.pollutant_limits(featured).collect()
    assert len(rows) == 10
    assert all(r.exceeds == (r.value > r.limit) for r in rows)
    assert {r.pollutant: r.limit for r in rows} == {
        "pm2_5": 15.0, "pm10": 45.0, "no2": 25.0, "so2": 40.0, "ozone": 100.0
    }
