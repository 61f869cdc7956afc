"""The histogram forest against a plain version, and what it must not depend on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.operators import forest, models, scorers
from skygauge.operators.forest import HistogramForest

NAMES = ["x0", "x1", "x2"]


def data(rows=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, rows), rng.integers(0, 40, rows), rng.integers(0, 3, rows)]).astype(float)
    return x, np.rint(3 * x[:, 0] - x[:, 1] + 10 * (x[:, 2] == 1) + rng.integers(-4, 4, rows))


def table(spark, x, y, parts=3):
    rows = [(*map(float, r), float(t), float(k)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "x0 double, x1 double, x2 double, y double, spare double").repartition(parts)


def fit(df, trees=4, depth=5, least=5, seed=7):
    made = HistogramForest(labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="all", maxBins=256, seed=seed)
    return models.fit(df, made, NAMES)


def predictions(model, df):
    return np.array([r.prediction for r in sorted(model.transform(df).collect(), key=lambda r: r.spare)])


def plain_tree(x, y, w, depth, least):
    """Prediction of each row by a greedy tree over all cuts between values of the rows that are drawn."""
    out = np.zeros(len(y))

    def grow(rows, left):
        mean = lambda r: (w[r] * y[r]).sum() / w[r].sum()
        of = lambda r: (w[r] * (y[r] - y.mean())).sum() ** 2 / w[r].sum()
        seen, best = rows[w[rows] > 0], (1e-9, None)
        for f in range(x.shape[1]) if left else []:
            for cut in np.unique(x[seen, f])[:-1]:
                a, b = seen[x[seen, f] <= cut], seen[x[seen, f] > cut]
                if min(w[a].sum(), w[b].sum()) >= least and of(a) + of(b) - of(seen) > best[0] + 1e-9:
                    best = (of(a) + of(b) - of(seen), (f, cut))
        if best[1] is None:
            out[rows] = mean(seen)
            return
        f, cut = best[1]
        grow(rows[x[rows, f] <= cut], left - 1)
        grow(rows[x[rows, f] > cut], left - 1)

    grow(np.arange(len(y)), depth)
    return out


def draws(df, tree, seed=7):
    key = [r.k for r in df.select("spare", F.xxhash64(F.lit("row"), "y", *NAMES).alias("k")).orderBy("spare").collect()]
    growth = forest._Growth(1, 1, 1, 1.0, seed, 0.0, 1.0, np.array([1]))
    return growth.draws(np.array(key, np.int64).view(np.uint64), tree)


@pytest.mark.parametrize("depth, least", [(1, 5), (4, 5), (9, 1), (9, 60)])
def test_equals_plain_trees(spark, depth, least):
    x, y = data()
    df = table(spark, x, y)
    model = fit(df, 3, depth, least)
    want = np.mean([plain_tree(x, y, draws(df, t), depth, least) for t in range(3)], axis=0)
    assert np.allclose(predictions(model, df), want, rtol=0, atol=1e-6)
    assert all(t.draws[t.feature < 0].min() >= least for t in model.trees)


def test_large_nodes_are_cut_by_jobs_and_the_trees_are_the_same(spark, monkeypatch):
    x, y = data(1500)
    one = fit(table(spark, x, y, 1), 5, 6)
    monkeypatch.setattr("skygauge.operators.boosting.BLOCK_ROWS", 100)
    monkeypatch.setattr("skygauge.operators.boosting.MEET", 2)
    df = table(spark, x, y, 7)
    # All large; some large; nodes that are large down to the last level, and one tree at a time.
    for task, shipped in ((1000, 10**9), (1480, 10**9), (3, 1)):
        monkeypatch.setattr(forest, "TASK_ROWS", task)
        monkeypatch.setattr(forest, "SHIPPED_ROWS", shipped)
        other = fit(df, 5, 6)
        assert np.array_equal(predictions(one, df), predictions(other, df))
        for a, b in zip(one.trees, other.trees, strict=True):
            for name in ("feature", "total", "draws"):
                assert np.array_equal(np.sort(getattr(a, name)), np.sort(getattr(b, name)))


def test_jobs_do_not_grow_with_levels(spark):
    """A fit was some jobs for each level of a few trees."""
    x, y = data(1500)
    df = table(spark, x, y).cache()
    jobs = []
    for trees, depth in ((2, 2), (12, 15)):
        spark.sparkContext.setJobGroup(f"forest {depth}", "")
        models.fit(df, models.forest(trees, depth, target="y"), NAMES)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest {depth}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] < 15


def test_rows_are_drawn_as_often_as_poisson():
    key = np.arange(200_000, dtype=np.uint64)
    growth = forest._Growth(1, 1, 1, 1.0, 42, 0.0, 1.0, np.array([1]))
    a, b = growth.draws(key, 0), growth.draws(key, 1)
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs((a == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.01


def test_missing_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 2.0, 0.0), (None, 0.0, 0.0, 5.0, 1.0), (2.0, 0.0, 0.0, None, 2.0), (1.0, 0.0, 0.0, 2.0, 3.0)], "x0 double, x1 double, x2 double, y double, spare double")
    model = fit(df, least=1)
    assert model.rows == 2 and all(t.feature[0] == -1 for t in model.trees)
    assert predictions(model, df).tolist() == [2.0] * 4
    third = df.withColumn("y", F.lit(1 / 3))
    assert np.allclose(predictions(fit(third, least=1), third), 1 / 3, rtol=1e-14)
    with pytest.raises(ValueError, match="no rows"):
        fit(df.limit(0))


def test_saved_and_as_arrays(spark, tmp_path, monkeypatch):
    x, y = data()
    df = table(spark, x, y)
    model = fit(df)
    models.save_model(model, str(tmp_path / "m"))
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert np.array_equal(predictions(model, df), predictions(again, df))
    monkeypatch.setattr(scorers, "FEATURE_COLS", NAMES)
    monkeypatch.setattr(scorers, "GROUP_NODES", 20)
    parts = scorers.scorer_of(spark, model)
    assert len(parts.groups) > 1 and np.allclose(parts.predict(x), predictions(model, df))


def test_as_good_as_sparks_forest(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import RandomForestRegressor

    x, y = data(3000)
    train, test = table(spark, x[:2400], y[:2400]), table(spark, x[2400:], y[2400:])
    settings = {"labelCol": "y", "numTrees": 10, "maxDepth": 8, "minInstancesPerNode": 5, "featureSubsetStrategy": "all", "maxBins": 256, "seed": 1}
    theirs = Pipeline(stages=[models.assembler(NAMES), RandomForestRegressor(**settings)]).fit(train)
    error = lambda m: np.abs(predictions(m, test) - y[2400:]).mean()
    assert error(models.fit(train, HistogramForest(**settings), NAMES)) < 1.05 * error(theirs)
