import numpy as np
import pandas as pd
import pytest

from skygauge.operators import evaluate, models, scorers
from skygauge.operators.features import build_features
from skygauge.plans import queries, reports
from skygauge.schemas import FEATURE_COLS, MODEL_METRICS, TARGET
from skygauge.session import stage

from conftest import raw_frame, to_spark


@pytest.fixture(scope="module")
def featured(spark):
    return stage(build_features(to_spark(spark, raw_frame(260, stations=2))), "test-featured")


@pytest.fixture(scope="module")
def fitted(spark, featured):
    train, test = models.split_for_training(featured)
    made = {
        "ridge": models.ridge(train),
        "forest": models.forest(trees=5, depth=5),
        "boosting": models.boosting(rounds=6, depth=4),
    }
    return train, test, {name: models.fit(train, e) for name, e in made.items()}


def test_ridge_is_the_closed_form(fitted):
    train, _, found = fitted
    pdf = train.toPandas()
    x, y = pdf[FEATURE_COLS].to_numpy(float), pdf[TARGET].to_numpy()
    centred = x - x.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + np.eye(44), centred.T @ (y - y.mean()))
    expected = centred @ weights + y.mean()
    got = models.score(found["ridge"], train).toPandas().sort_values(["station", "pos"])
    order = pdf.reset_index().sort_values(["station", "pos"])["index"].to_numpy()
    assert np.allclose(got.prediction, expected[order], rtol=1e-6, atol=1e-6)


def test_split_is_chronological(fitted):
    train, test, _ = fitted
    a, b = train.toPandas(), test.toPandas()
    for s in a.station.unique():
        n = (a.station == s).sum() + (b.station == s).sum()
        assert (a.station == s).sum() == int(n * 0.8)
        assert a[a.station == s].timestamp.max() < b[b.station == s].timestamp.min()


@pytest.mark.parametrize("name", ["ridge", "forest", "boosting"])
def test_arrays_reproduce_the_model(spark, fitted, name):
    _, test, found = fitted
    pdf = models.score(found[name], test).toPandas()
    got = scorers.scorer_of(spark, found[name]).predict(pdf[FEATURE_COLS].to_numpy(float))
    assert np.allclose(got, pdf.prediction, rtol=1e-12)


@pytest.mark.parametrize("name", ["forest", "boosting"])
def test_groups_of_trees_add_up(spark, fitted, name, monkeypatch):
    _, test, found = fitted
    pdf = models.score(found[name], test).toPandas()
    monkeypatch.setattr(scorers, "GROUP_NODES", 3)
    scorer = scorers.scorer_of(spark, found[name])
    assert len(scorer.groups) > 1
    assert np.allclose(scorer.predict(pdf[FEATURE_COLS].to_numpy(float)), pdf.prediction, rtol=1e-12)


def test_save_and_load(spark, fitted, tmp_path):
    _, test, found = fitted
    models.save_model(found["boosting"], str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    one = models.score(found["boosting"], test).select("prediction").toPandas()
    two = models.score(again, test).select("prediction").toPandas()
    pd.testing.assert_frame_equal(one, two)


def test_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0, 9.0]), np.array([1.5, 2.0, 3.0, 10.0])
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "pm2_5 double, prediction double")
    row = evaluate.regression_metrics(df).first()
    assert row.mae == pytest.approx(np.abs(y - p).mean())
    assert row.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    constant = spark.createDataFrame([(1.0, 1.0)], df.schema)
    assert evaluate.regression_metrics(constant).first().r2 is None


def test_selection_breaks_ties_by_order(spark):
    rows = [("a", 0, 0.9, 1.0, 0.1), ("b", 1, 0.70049, 1.0, 0.1), ("c", 2, 0.70041, 1.0, 0.1)]
    metrics = spark.createDataFrame(rows, MODEL_METRICS)
    assert evaluate.select_model(metrics).first().model == "b"
    table = {r.model: r for r in reports.model_comparison(metrics).collect()}
    assert [table[m].selected for m in "abc"] == [False, True, False]
    assert table["c"].mae == 0.7


def test_comparison(featured, fitted):
    train = fitted[0]
    found = models.train_and_compare(
        featured, {models.RIDGE: models.ridge(train), models.BOOSTING: models.boosting(rounds=3, depth=3)}
    )
    rows = {r.model: r for r in found.metrics.collect()}
    assert set(rows) == set(found.models) == {models.RIDGE, models.BOOSTING}
    assert found.winner == min(rows, key=lambda m: rows[m].mae)


def test_comparison_at_reference_settings_takes_few_jobs(spark, featured):
    """200 trees of depth 15 and 300 rounds; Spark's own forest took hundreds of jobs, whatever the number of rows."""
    spark.sparkContext.setJobGroup("compare", "")
    found = models.train_and_compare(featured)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("compare"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    forest, boosted = found.models[models.FOREST], found.models[models.BOOSTING]
    assert len(forest.trees) == 200 and len(boosted.trees) == 300 and jobs < 120


def test_attribution_of_a_table_of_some_blocks_takes_few_jobs(spark, featured, monkeypatch):
    """Several blocks were a job for each of 1800 levels."""
    monkeypatch.setattr("skygauge.operators.boosting.BLOCK_ROWS", 50)
    monkeypatch.setattr(queries.tables, "featured", lambda *args: featured)
    spark.sparkContext.setJobGroup("shap", "")
    found = queries.QUERIES["tree_shap"](spark, "").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("shap"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.feature for r in found) == sorted(FEATURE_COLS) and jobs < 60


def test_default_settings():
    forest, boosting = models.forest(), models.boosting()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (200, 15, 5)
    own = boosting.settings
    assert (own.rounds, own.rate, own.depth, own.row_share, own.column_share) == (300, 0.05, 6, 0.8, 0.8)
    assert (own.penalty, own.least_weight, own.least_gain, own.bins) == (1.0, 1.0, 0.0, 256)


TREES = {"numTrees": 200, "maxDepth": 15}, {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05}


@pytest.mark.parametrize(
    "name, fitted",
    [("train_forest", TREES[:1]), ("train_compare", TREES)]
    + [(n, TREES[1:]) for n in ("train_boosting", "forecast_boosting", "backtest_boosting", "tree_shap")],
)
def test_queries_fit_the_models_of_the_reference(spark, featured, monkeypatch, name, fitted):
    """Which trees are asked for; the fit itself is left out, as it takes minutes."""
    asked = []

    class Stop(Exception):
        pass

    def record(train, estimator, *args):
        if isinstance(estimator, models.HistogramBoosting):
            own = estimator.settings
            asked.append({"maxIter": own.rounds, "maxDepth": own.depth, "stepSize": own.rate})
        else:
            asked.append({p.name: v for p, v in estimator.extractParamMap().items()})
        if len([a for a in asked if "maxDepth" in a]) == len(fitted):
            raise Stop

    class Blank:
        def first(self):
            return {"mae": 0.0, "rmse": 0.0, "r2": 0.0}

    monkeypatch.setattr(queries.tables, "featured", lambda *args: featured)
    monkeypatch.setattr(models, "fit", record)
    monkeypatch.setattr(models, "score", lambda *args: None)
    monkeypatch.setattr(models, "regression_metrics", lambda *args: Blank())
    with pytest.raises(Stop):
        queries.QUERIES[name](spark, "")
    trees = [a for a in asked if "maxDepth" in a]
    assert [{k: a[k] for k in want} for a, want in zip(trees, fitted, strict=True)] == list(fitted)
