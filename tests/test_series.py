import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.operators import merge, series
from skygauge.schemas import MEASUREMENTS

from conftest import by_key, raw_frame, to_spark


def test_positions_do_not_depend_on_buckets(spark):
    pdf = raw_frame(200).sample(frac=0.6, random_state=3)
    df = to_spark(spark, pdf)
    expected = pdf.sort_values(["station", "timestamp"])
    expected = expected.groupby("station").cumcount().tolist()
    sizes = pdf.groupby("station").size()
    for hours in (7, 64, 5000):
        rows = by_key(series.with_positions(df, hours))
        assert rows.pos.tolist() == expected
        assert all(rows.n_rows == rows.station.map(sizes))


def test_chunks_carry_the_halo(spark):
    df = series.with_positions(to_spark(spark, raw_frame(100, stations=1)))
    chunks = series.overlapping_chunks(df, halo=5, chunk_rows=20).toPandas()
    third = sorted(chunks[chunks._chunk == 2].pos)
    assert third == list(range(35, 60))
    assert len(chunks[chunks._chunk == chunks._home]) == 100
    with pytest.raises(ValueError):
        series.overlapping_chunks(df, halo=30, chunk_rows=20)


def test_split_cut_position(spark):
    rows = series.chronological_split(to_spark(spark, raw_frame(11, stations=1))).toPandas()
    assert rows.is_train.sum() == int(11 * 0.8)
    assert rows[rows.is_train].timestamp.max() < rows[~rows.is_train].timestamp.min()


def test_seven_days_include_the_bound(spark):
    rows = series.trailing_days(to_spark(spark, raw_frame(8 * 24, stations=1)))
    assert rows.count() == 169


def test_latest_row(spark):
    pdf = raw_frame(50)
    rows = by_key(series.latest_rows(to_spark(spark, pdf)))
    assert rows.timestamp.tolist() == [pdf.timestamp.max()] * 2


def test_regularize_adds_missing_hours(spark):
    pdf = raw_frame(100, stations=1)
    kept = pdf.drop(index=range(20, 60))
    rows = by_key(series.regularize(to_spark(spark, kept), bucket_hours=16))
    assert rows.timestamp.tolist() == pdf.timestamp.tolist()
    assert rows.loc[20:59, MEASUREMENTS].isna().all().all()
    assert np.allclose(rows.loc[60:, "pm10"], pdf.loc[60:, "pm10"], equal_nan=True)


def test_merge_and_dedup(spark):
    pdf = raw_frame(10, stations=1, missing=0)
    both = to_spark(spark, pdf)
    air = both.select("station", "timestamp", "pm2_5", "pm10", "no2", "ozone", "co", "so2")
    weather = both.select("station", "timestamp", *MEASUREMENTS[6:]).filter(F.hour("timestamp") != 3)
    history = merge.merge_weather(air, weather)
    assert history.count() == 9
    ahead = air.withColumn("pm2_5", F.lit(-1.0)).withColumn("is_forecast", F.lit(True))
    combined = merge.combine(history, ahead)
    rows = by_key(combined)
    assert len(rows) == 10
    assert rows.is_forecast.sum() == 1 and rows[rows.is_forecast].timestamp.dt.hour.tolist() == [3]
    assert rows[rows.is_forecast].temperature.isna().all()


def test_many_copies_of_one_hour_collapse(spark):
    pdf = raw_frame(3, stations=1, missing=0)
    df = to_spark(spark, pdf)
    copies = df.withColumn("is_forecast", F.lit(True)).crossJoin(spark.range(500)).drop("id")
    rows = by_key(merge.dedup_hours(merge.stack(df, copies.repartition(16))))
    assert len(rows) == 3 and not rows.is_forecast.any()


def test_empty_side_gives_empty_merge(spark):
    df = to_spark(spark, raw_frame(3))
    assert merge.merge_weather(
        df.select("station", "timestamp", *MEASUREMENTS[:6]),
        df.select("station", "timestamp", *MEASUREMENTS[6:]).limit(0),
    ).isEmpty()


def test_trailing_range_reaches_the_scan(spark, tmp_path):
    df = to_spark(spark, raw_frame(24 * 10, stations=1))
    df.write.parquet(str(tmp_path / "raw"))
    saved = spark.read.parquet(str(tmp_path / "raw"))
    rows = merge.trailing_range(saved, dt.date(2025, 3, 8), 3)
    stamps = rows.toPandas().timestamp
    assert stamps.min() == dt.datetime(2025, 3, 5) and stamps.max() == dt.datetime(2025, 3, 7, 23)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan


def test_duplicate_hours_are_refused(spark):
    df = to_spark(spark, raw_frame(5, stations=1))
    assert merge.require_unique_hours(df).count() == 5
    with pytest.raises(Exception, match="duplicate hour"):
        merge.require_unique_hours(df.union(df)).count()
