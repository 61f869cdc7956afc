import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skygauge.functions.aqi import BREAKPOINTS
from skygauge.operators import backtest, forecast, models
from skygauge.operators.features import build_features, positioned
from skygauge.operators.scorers import LinearScorer, scorer_of
from skygauge.operators.series import latest_rows
from skygauge.plans.queries import stub_scorer
from skygauge.schemas import FEATURE_COLS
from skygauge.session import stage

from conftest import by_key, raw_frame, to_spark


@pytest.fixture(scope="module")
def featured(spark):
    return stage(build_features(to_spark(spark, raw_frame(400, stations=2))), "test-featured")


def index_2012(v):
    for lo, hi, alo, ahi in BREAKPOINTS["2012", "pm2_5"]:
        if lo <= v <= hi:
            return float(round((ahi - alo) / (hi - lo) * (v - lo) + alo))
    return 500.0


def plain_path(origin: pd.Series, weights: dict, intercept: float, steps: int) -> list:
    """One origin, one step at a time, in plain Python."""
    known, path = [origin.pm2_5], []
    for step in range(1, steps + 1):
        hour = (origin.hour + step) % 24
        dow = (origin.day_of_week + step // 24) % 7
        x = {c: origin[c] for c in forecast.CARRIED}
        x |= {"hour": hour, "day_of_week": dow, "month": origin.month}
        x |= {"is_weekend": int(dow > 4), "is_rush_hour": int(hour in (7, 8, 9, 17, 18, 19))}
        for name, value, period in (("hour", hour, 24), ("month", origin.month, 12), ("dow", dow, 7)):
            x[name + "_sin"] = math.sin(2 * math.pi * value / period)
            x[name + "_cos"] = math.cos(2 * math.pi * value / period)
        for lag in (1, 3, 6, 12, 24, 48):
            value = known[-lag] if len(known) >= lag else origin[f"pm2_5_lag{lag}"]
            x[f"pm2_5_lag{lag}"], x[f"aqi_lag{lag}"] = value, index_2012(value)
        for n in (3, 6, 12, 24):
            tail = known[-n:]
            mean = sum(tail) / len(tail)
            x[f"pm2_5_roll{n}"], x[f"aqi_roll{n}"] = mean, index_2012(mean)
        x["pm_ratio"] = known[-1] / ((origin.pm10 if origin.pm10 > 0 else 1) + 1e-6)
        x["wind_dispersion"] = origin.wind_speed / (known[-1] + 1e-6)
        x["heat_humidity"] = origin.temperature * origin.humidity / 100
        value = max(0.0, intercept + sum(weights[f] * x[f] for f in FEATURE_COLS))
        known.append(value)
        path.append(value)
    return path


def test_equals_plain_python(spark, featured):
    rng = np.random.default_rng(5)
    weights = rng.normal(0, 0.02, 44)
    weights[FEATURE_COLS.index("pm2_5_lag1")] = 0.4
    weights[FEATURE_COLS.index("wind_dispersion")] = 1e-7
    scorer = LinearScorer(weights, 5.0)
    origins = positioned(featured).filter("pos % 40 = 7")
    found = by_key(forecast.forecast_paths(scorer, origins))
    rows = by_key(origins)
    for got, (_, origin) in zip(found.predictions, rows.iterrows()):
        expected = plain_path(origin, dict(zip(FEATURE_COLS, weights)), 5.0, 72)
        assert np.allclose(got, expected, rtol=1e-9)
        assert len(got) == 72 and min(got) >= 0


def frame(**values):
    row = {c: 1.0 for c in forecast.ORIGIN_COLS}
    row |= {"station": "A", "timestamp": pd.Timestamp("2025-01-31 20:00"), "hour": 20, "day_of_week": 4, "month": 1}
    return pd.DataFrame([row | values])


def only(feature, weight=1.0):
    return LinearScorer(np.array([weight * (f == feature) for f in FEATURE_COLS]), 0.0)


def test_calendar_is_carried_or_exact():
    paths = {f: forecast.advance(only(f), frame(), 24)[0] for f in ("hour", "day_of_week", "month")}
    assert paths["hour"][4] == 1 and paths["day_of_week"][4] == 4 and paths["day_of_week"][23] == 5
    exact = {f: forecast.advance(only(f), frame(), 24, "exact")[0] for f in ("day_of_week", "month")}
    assert exact["day_of_week"][4] == 5
    assert exact["month"][2] == 1 and exact["month"][3] == 2
    assert set(paths["month"]) == {1}


def test_lags_before_the_origin():
    batch = frame(pm2_5=7.0, pm2_5_lag3=30.0, pm2_5_lag6=60.0)
    assert forecast.advance(only("pm2_5_lag3"), batch, 3)[0][2] == 7.0
    assert forecast.advance(only("pm2_5_lag6"), batch, 3)[0][2] == 60.0
    batch[forecast.RECENT] = [np.arange(48.0)]
    assert forecast.advance(only("pm2_5_lag6"), batch, 3, lags="exact")[0].tolist() == [42.0, 43.0, 44.0]


def test_negative_predictions_are_clamped():
    assert forecast.advance(only("hour", -1.0), frame(), 5).tolist() == [[0.0] * 5]


def test_recent_values(spark, featured):
    rows = by_key(forecast.with_recent(featured))
    part = rows[rows.station == "S1"].reset_index(drop=True)
    assert part.recent[100].tolist() == part.pm2_5[53:101].tolist()
    assert len(part.recent[0]) == 1
    later = forecast.with_recent(featured).filter(F.size("recent") == 48)
    paths = forecast.forecast_paths(only("pm2_5_lag48"), latest_rows(later), 10, lags="exact")
    got = by_key(paths).predictions[0]
    series = rows[rows.station == "S0"].pm2_5.tolist()
    assert got.tolist() == series[-48:-38]


def test_table(spark, featured):
    table = forecast.forecast_table(forecast.forecast_paths(stub_scorer(), latest_rows(featured)))
    rows = table.toPandas().sort_values(["station", "horizon_hour"])
    assert len(rows) == 144 and rows.pm2_5_predicted.min() >= 0
    last = featured.toPandas().groupby("station").timestamp.max()
    hours = (rows.timestamp - rows.station.map(last)) / pd.Timedelta(hours=1)
    assert (hours == rows.horizon_hour).all()
    sample = forecast.every_nth_hour(table).toPandas()
    assert sorted(set(sample.horizon_hour)) == [1, 13, 25, 37, 49, 61]


def test_unrolled_form_agrees(spark, featured):
    train, _ = models.split_for_training(featured)
    model = models.fit(train, models.boosting(rounds=3, depth=3))
    origins = latest_rows(featured)
    batched = by_key(forecast.paths_for_model(model, origins, 4))
    unrolled = by_key(forecast.forecast_unrolled(model, origins, 4))
    assert np.allclose(np.vstack(batched.predictions), np.vstack(unrolled.predictions))


def test_groups_of_trees_give_the_same_paths(spark, featured, monkeypatch):
    train, _ = models.split_for_training(featured)
    model = models.fit(train, models.boosting(rounds=3, depth=2))
    origins = latest_rows(featured)
    whole = by_key(forecast.paths_for_model(model, origins, 4))
    monkeypatch.setattr("skygauge.operators.scorers.GROUP_NODES", 1)
    parts = by_key(forecast.paths_for_model(model, origins, 4))
    assert np.allclose(np.vstack(whole.predictions), np.vstack(parts.predictions), rtol=1e-12)


def test_options_reach_the_public_calls(spark, featured):
    train, _ = models.split_for_training(featured)
    model = models.fit(train, models.boosting(rounds=2, depth=3))
    options = {"calendar": "exact", "lags": "exact", "standard": "2024"}
    table = by_key(forecast.latest_forecast(model, featured, 6, **options))
    origins = latest_rows(forecast.with_recent(featured))
    paths = forecast.forecast_paths(scorer_of(spark, model), origins, 6, **options)
    expected = by_key(forecast.forecast_table(paths, "2024"))
    assert np.allclose(table.pm2_5_predicted, expected.pm2_5_predicted)
    assert list(table.aqi_predicted) == list(expected.aqi_predicted)
    few = backtest.recursive_backtest(model, featured, {"6hr": 6}, at_most=2, **options).collect()
    all_ = backtest.recursive_backtest(model, featured, {"6hr": 6}, step=1, at_most=10**6).collect()
    assert few[0].n_origins == 4 < all_[0].n_origins


# -- backtest ---------------------------------------------------------------------------


def test_origins(spark, featured):
    rows = by_key(backtest.backtest_origins(featured))
    n = 400 - 48
    for s in ("S0", "S1"):
        expected = list(range(int(n * 0.8), n - 24, 10))
        part = rows[rows.station == s]
        assert part.pos.tolist() == expected
        assert part.reach.tolist() == [next(h for h in (72, 48, 24) if p < n - h) for p in expected]


def test_no_more_than_fifty_origins(spark):
    pdf = pd.DataFrame({"station": "A", "timestamp": pd.date_range("2024-01-01", periods=6000, freq="h")})
    pdf["pm2_5"] = 1.0
    df = to_spark(spark, pdf, "station string, timestamp timestamp_ntz, pm2_5 double")
    rows = by_key(backtest.backtest_origins(df))
    assert rows.pos.tolist() == [4800 + 10 * i for i in range(50)]


def test_backtest_equals_brute_force(spark, featured):
    scorer = stub_scorer()
    rows = stage(positioned(featured), "test-positioned")
    origins = backtest.backtest_origins(rows)
    paths = forecast.forecast_paths(scorer, origins, keep=("pos", "reach"))
    aligned = backtest.align_actuals(forecast.explode_paths(paths), rows)
    found = {r.horizon_hours: r for r in backtest.horizon_mae(aligned).collect()}
    weights = dict(zip(FEATURE_COLS, scorer.coefficients))
    pdf = by_key(rows)
    for hours in (24, 48):
        errors = []
        for _, part in pdf.groupby("station"):
            part, n = part.reset_index(drop=True), len(part)
            for at in list(range(int(n * 0.8), n - hours, 10))[:50]:
                path = plain_path(part.loc[at], weights, scorer.intercept, hours)
                actual = part.pm2_5[at + 1 : at + 1 + hours]
                errors.append(np.abs(actual.to_numpy() - path).mean())
        assert found[hours].mae == pytest.approx(np.mean(errors), rel=1e-9)
        assert found[hours].n_origins == len(errors)
    assert found[72].mae is None and found[72].n_origins == 0


def test_backtest_of_a_fitted_model(spark, featured):
    train, _ = models.split_for_training(featured)
    model = models.fit(train, models.boosting(rounds=2, depth=3))
    rows = backtest.recursive_backtest(model, featured).orderBy("horizon_hours").collect()
    assert [r.label for r in rows] == ["24hr", "48hr", "72hr"]
    assert rows[0].mae > 0 and rows[2].mae is None
