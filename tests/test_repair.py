import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygauge.operators import repair
from skygauge.schemas import MEASUREMENTS

from conftest import by_key, raw_frame, to_spark


def one_column(spark, values):
    start = dt.datetime(2025, 1, 1)
    rows = [("A", start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station string, timestamp timestamp_ntz, pm2_5 double")


@pytest.mark.parametrize("hours", [1, 3, 4, 1000])
def test_interpolation_edges(spark, hours):
    values = [None, None, 1.0, None, None, 4.0, None, 2.0, None, None]
    rows = by_key(repair.interpolate(one_column(spark, values), bucket_hours=hours))
    got = [None if np.isnan(v) else v for v in rows.pm2_5]
    assert got == [None, None, 1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 2.0, 2.0]
    assert rows.pos.tolist() == list(range(10))


@pytest.mark.parametrize("hours", [11, 400])
def test_interpolation_equals_pandas(spark, hours):
    pdf = raw_frame(150, stations=3, missing=0.6).sample(frac=0.8, random_state=2)
    pdf.loc[pdf.station == "S1", "ozone"] = np.nan
    rows = by_key(repair.interpolate(to_spark(spark, pdf), bucket_hours=hours))
    pdf = pdf.sort_values(["station", "timestamp"]).reset_index(drop=True)
    for c in MEASUREMENTS:
        expected = pdf.groupby("station")[c].transform(lambda s: s.interpolate(method="linear"))
        assert np.allclose(rows[c], expected, equal_nan=True, rtol=1e-12, atol=1e-12), c


def expected_quantiles(values: pd.Series):
    filled = values.fillna(values.median())
    return values.median(), filled.quantile(0.01), filled.quantile(0.99)


@pytest.mark.parametrize(
    "n, missing, distinct",
    [(1, 0, 10), (2, 1, 10), (7, 3, 3), (100, 90, 50), (5000, 40, 10**6), (20000, 6000, 5), (3000, 0, 1)],
)
def test_quantiles_are_exact(spark, n, missing, distinct):
    rng = np.random.default_rng(n)
    values = np.concatenate([np.full(missing, np.nan), rng.integers(0, distinct, n) / 7.0])
    pdf = pd.DataFrame({"pm2_5": values, "co": np.where(np.isnan(values), np.nan, rng.lognormal(size=len(values)))})
    pdf["station"] = "A"
    pdf["timestamp"] = pd.date_range("2020-01-01", periods=len(pdf), freq="h")
    df = to_spark(spark, pdf, "pm2_5 double, co double, station string, timestamp timestamp_ntz")
    found = repair.station_quantiles(df.repartition(8), ["pm2_5", "co"]).toPandas().set_index("measure")
    for c in ("pm2_5", "co"):
        got = found.loc[c, ["median", "lower", "upper"]].astype(float).tolist()
        assert np.allclose(got, expected_quantiles(pdf[c]), rtol=1e-12), c


def test_all_missing_column_has_no_quantiles(spark):
    df = one_column(spark, [None, None, None])
    rows = repair.repair(df).toPandas()
    assert rows.pm2_5.isna().all() and len(rows) == 3


def test_repair_order_and_idempotent_clip(spark):
    pdf = raw_frame(300, stations=2, missing=0.3)
    pdf.loc[(pdf.station == "S0") & (pdf.index < 30), "no2"] = np.nan
    fixed = repair.repair(to_spark(spark, pdf), bucket_hours=37)
    rows = by_key(fixed)
    for c in MEASUREMENTS:
        for s, part in pdf.groupby("station"):
            filled = part[c].interpolate(method="linear")
            filled = filled.fillna(filled.median())
            clipped = filled.clip(filled.quantile(0.01), filled.quantile(0.99))
            assert np.allclose(rows[rows.station == s][c], clipped, rtol=1e-12), (s, c)


def test_result_does_not_depend_on_partitions(spark):
    pdf = raw_frame(200, stations=2)
    few = by_key(repair.repair(to_spark(spark, pdf).coalesce(1)))
    many = by_key(repair.repair(to_spark(spark, pdf).repartition(13), bucket_hours=20))
    pd.testing.assert_frame_equal(few, many)


def test_fit_on_training_rows_only(spark):
    values = [float(v) for v in range(80)] + [1e6] * 20
    rows = by_key(repair.repair(one_column(spark, values), train_share=0.8))
    assert rows.pm2_5.max() == pytest.approx(np.quantile(np.arange(80), 0.99))


def test_no_task_gets_a_whole_station(spark):
    """The shuffles of rows are keyed by more than the station."""
    df = to_spark(spark, raw_frame(50))
    plan = repair.interpolate(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan
    salted = repair.station_quantiles(df, ["pm2_5"])._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in salted
    assert df.select(F.countDistinct("station")).first()[0] == 2
