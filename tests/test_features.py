import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygauge.functions import calendar
from skygauge.operators import features
from skygauge.operators.series import with_positions
from skygauge.schemas import FEATURE_COLS, FEATURED, LAGS, MEASUREMENTS, ROLLS

from conftest import by_key, raw_frame, to_spark


def test_feature_list():
    assert len(FEATURE_COLS) == 44 and len(set(FEATURE_COLS)) == 44
    assert len(FEATURED.names) == 49


def test_calendar(spark):
    stamps = [dt.datetime(2025, 3, 3, 8), dt.datetime(2025, 3, 2, 0)]
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    parts = calendar.calendar_parts(F.col("t"))
    rows = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert rows[0].asDict() == {"hour": 8, "day_of_week": 0, "month": 3, "is_weekend": 0, "is_rush_hour": 1}
    assert rows[1].asDict() == {"hour": 0, "day_of_week": 6, "month": 3, "is_weekend": 1, "is_rush_hour": 0}


def test_time_text(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 3, 3, 8, 5),)], "t timestamp_ntz")
    row = df.select(
        calendar.weekday_clock(F.col("t")),
        calendar.long_clock(F.col("t")),
        calendar.horizon_text(F.lit(7)),
        calendar.plus_hours(F.col("t"), F.lit(30)),
        calendar.hour_start(F.col("t")),
        calendar.epoch_hours(F.col("t")),
    ).first()
    assert tuple(row) == (
        "Mon 08:05",
        "Mar 03, 2025  08:05",
        "7h ahead",
        dt.datetime(2025, 3, 4, 14, 5),
        dt.datetime(2025, 3, 3, 8),
        (dt.datetime(2025, 3, 3, 8) - dt.datetime(1970, 1, 1)) // dt.timedelta(hours=1),
    )


@pytest.mark.parametrize("chunk_rows", [48, 61, 512])
def test_history_equals_pandas(spark, chunk_rows):
    pdf = raw_frame(200, stations=2, missing=0.05)
    pdf["aqi"] = np.arange(len(pdf)) % 97
    df = to_spark(spark, pdf[["station", "timestamp", "pm2_5", "aqi"]], "station string, timestamp timestamp_ntz, pm2_5 double, aqi int")
    rows = by_key(features.add_history(with_positions(df, 50), chunk_rows=chunk_rows))
    assert len(rows) == len(pdf)
    for c in ("pm2_5", "aqi"):
        grouped = pdf.groupby("station")[c]
        for k in LAGS:
            assert np.allclose(rows[f"{c}_lag{k}"], grouped.shift(k), equal_nan=True)
        for n in ROLLS:
            mean = grouped.transform(lambda s, n=n: s.rolling(n).mean())
            assert np.allclose(rows[f"{c}_roll{n}"], mean, equal_nan=True)


def test_rolling_needs_a_full_window(spark):
    start = dt.datetime(2025, 1, 1)
    data = [("A", start + dt.timedelta(hours=i), float(i + 1)) for i in range(6)]
    df = with_positions(spark.createDataFrame(data, "station string, timestamp timestamp_ntz, pm2_5 double"))
    rows = by_key(features.add_history(df, ("pm2_5",), [], [3], chunk_rows=2))
    assert [None if np.isnan(v) else v for v in rows.pm2_5_roll3] == [None, None, 2.0, 3.0, 4.0, 5.0]


def test_warm_up_leaves_one_row(spark):
    df = to_spark(spark, raw_frame(49, stations=1, missing=0))
    rows = features.build_features(df, bucket_hours=10, chunk_rows=48)
    assert rows.count() == 1
    assert rows.columns == FEATURED.names
    assert [f.dataType for f in rows.schema] == [f.dataType for f in FEATURED]


def test_feature_table_values(spark):
    pdf = raw_frame(120, stations=2, missing=0.1)
    small = by_key(features.build_features(to_spark(spark, pdf), bucket_hours=31, chunk_rows=50))
    large = by_key(features.build_features(to_spark(spark, pdf)))
    pd.testing.assert_frame_equal(small, large)
    assert np.allclose(small.pm_ratio, small.pm2_5 / (small.pm10 + 1e-6))
    assert np.allclose(small.wind_dispersion, small.wind_speed / (small.pm2_5 + 1e-6))
    assert np.allclose(small.heat_humidity, small.temperature * small.humidity / 100)
    assert np.allclose(small.hour_sin, np.sin(2 * np.pi * small.hour / 24))
    assert np.allclose(small.dow_cos, np.cos(2 * np.pi * small.day_of_week / 7))


def test_forecast_rows_do_not_train(spark):
    pdf = raw_frame(60, stations=1, missing=0)
    pdf.loc[55:, "is_forecast"] = True
    assert features.build_features(to_spark(spark, pdf)).count() == 55 - 48


def test_leak_safe_features_do_not_see_the_target(spark):
    pdf = raw_frame(80, stations=1, missing=0)
    changed = pdf.copy()
    changed.loc[79, "pm2_5"] = pdf.pm2_5[:64].median()
    one = by_key(features.build_features(to_spark(spark, pdf), leak_safe=True)).iloc[-1]
    two = by_key(features.build_features(to_spark(spark, changed), leak_safe=True)).iloc[-1]
    names = [c for c in FEATURE_COLS]
    assert one[names].tolist() == two[names].tolist()


def test_missing_columns_and_all_null_column(spark):
    pdf = raw_frame(60, stations=1, missing=0)
    without = to_spark(spark, pdf).drop("ozone", "pressure")
    rows = features.build_features(without)
    assert "ozone" not in rows.columns and rows.count() == 12
    empty = to_spark(spark, pdf).withColumn("co", F.lit(None).cast("double"))
    assert features.build_features(empty).isEmpty()


def test_stats(spark):
    df = to_spark(spark, raw_frame(60, missing=0))
    row = features.aqi_stats(features.add_aqi(df)).first()
    assert row.n_rows == 120 and 0 <= row.aqi_min <= row.aqi_mean <= row.aqi_max <= 500
    counts = features.row_counts(df).first()
    assert tuple(counts) == (120, 0, 120)
    assert set(MEASUREMENTS) <= set(df.columns)


def test_causal_features_do_not_look_ahead(spark):
    """All values of the last hours change, and no earlier feature does; gaps cross time buckets."""
    pdf = raw_frame(150, stations=2, missing=0.4)
    cut = sorted(pdf.timestamp.unique())[100]
    changed = pdf.copy()
    for c in MEASUREMENTS:
        changed.loc[changed.timestamp >= cut, c] = 7.0
    one, two = (
        by_key(features.build_features(to_spark(spark, p), causal=True, bucket_hours=24, chunk_rows=64).filter(F.col("timestamp") < F.lit(cut)))
        for p in (pdf, changed)
    )
    assert len(one) > 50
    pd.testing.assert_frame_equal(one, two)
    whole = by_key(features.build_features(to_spark(spark, pdf), causal=True))
    pd.testing.assert_frame_equal(whole[whole.timestamp < cut].reset_index(drop=True), one)
    for c in MEASUREMENTS:
        want = pdf.sort_values(["station", "timestamp"]).groupby("station")[c].ffill()
        assert set(whole[c]) <= set(want.dropna())
