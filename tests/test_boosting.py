"""Histogram boosting against a plain version, and what it must not depend on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.operators import attribution, boosting, models, scorers
from skygauge.operators.boosting import HistogramBoosting, Settings


def data(rows=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, rows), rng.integers(0, 40, rows), rng.integers(0, 3, rows), rng.normal(size=rows)])
    return x.astype(float), np.rint(3 * x[:, 0] - x[:, 1] + 10 * (x[:, 2] == 1) + 5 * (x[:, 3] > 0.3))


def table(spark, x, y, parts=3):
    rows = [(*map(float, r), float(t), float(k)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    names = [f"x{k}" for k in range(x.shape[1])]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y", "spare"])).repartition(parts), names


def plain_boosting(x, y, s):
    """Exact greedy trees over all cuts between values, no sampling: predictions after each round."""
    prediction = np.full(len(y), float(f"{y.mean():.10g}"))
    paths = []
    for _ in range(s.rounds):
        g = prediction - y

        def grow(rows, level, g=g):
            total, n = g[rows].sum(), len(rows)
            best = (max(s.least_gain, boosting.LEAST_GAIN), None)
            for f in range(x.shape[1]) if level < s.depth else []:
                for cut in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= cut]
                    gl, nl = g[left].sum(), len(left)
                    if min(nl, n - nl) < s.least_weight:
                        continue
                    of = lambda a, b: a * a / (b + s.penalty)
                    gain = (of(gl, nl) + of(total - gl, n - nl) - of(total, n)) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
            if best[1] is None:
                step[rows] = -total / (n + s.penalty) * s.rate
                return
            f, cut = best[1]
            grow(rows[x[rows, f] <= cut], level + 1)
            grow(rows[x[rows, f] > cut], level + 1)

        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        prediction = prediction + step
        paths.append(prediction.copy())
    return paths


def fit(df, names, **settings):
    return HistogramBoosting(Settings(**settings), "y").fit(df, names)


def predictions(model, df):
    return np.array([r.prediction for r in sorted(model.transform(df).collect(), key=lambda r: r.spare)])


@pytest.mark.parametrize("depth, weight, gain", [(1, 1.0, 0.0), (3, 1.0, 0.0), (3, 20.0, 30.0)])
def test_equals_plain_boosting(spark, depth, weight, gain):
    x, y = data()
    x = x[:, :3]
    df, names = table(spark, x, y)
    settings = {"rounds": 12, "rate": 0.3, "depth": depth, "row_share": 1.0, "column_share": 1.0, "least_weight": weight, "least_gain": gain}
    model = fit(df, names, **settings)
    want = plain_boosting(x, y, Settings(**settings))
    assert np.allclose(predictions(model, df), want[-1], rtol=1e-7, atol=1e-7)


def test_does_not_depend_on_partitions_or_blocks(spark, monkeypatch):
    """One task with all blocks, and jobs over many partitions with predictions saved in between: the same bits."""
    x, y = data(1500)
    df, names = table(spark, x, y, 1)
    settings = {"rounds": 5, "depth": 3, "row_share": 0.7, "column_share": 0.6}
    monkeypatch.setattr(boosting, "ROUNDS_A_JOB", 3)
    one = fit(df, names, **settings)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "SAVE_ROUNDS", 2)
    jobs, over = [], boosting._Growth.over
    monkeypatch.setattr(boosting._Growth, "over", lambda self, blocks: jobs.append(blocks.getNumPartitions()) or over(self, blocks))
    other = fit(df.repartition(7), names, **settings)
    assert len(jobs) == 5 and min(jobs) > 1
    assert len(one.trees) == len(other.trees) == 5 and one.base == other.base
    for a, b in zip(one.trees, other.trees, strict=True):
        for name in ("feature", "cut", "threshold", "value", "cover"):
            assert np.array_equal(getattr(a, name), getattr(b, name))


def test_learns_and_draws(spark):
    x, y = data(1500)
    df, names = table(spark, x, y)
    model = fit(df, names, rounds=40, rate=0.2, depth=4)
    assert np.abs(predictions(model, df) - y).mean() < 0.25 * np.abs(y - y.mean()).mean()
    covers = [t.cover[0] for t in model.trees]
    assert len(set(covers)) > 20 and 0.7 * 1500 < min(covers) and max(covers) < 0.9 * 1500
    drawn = boosting._drawn(np.arange(100_000, dtype=np.uint64), 1, 2, 0.8)
    assert abs(drawn.mean() - 0.8) < 0.01
    assert abs((drawn & boosting._drawn(np.arange(100_000, dtype=np.uint64), 1, 3, 0.8)).mean() - 0.64) < 0.01


def test_many_values_are_cut_at_quantiles(spark):
    rows = spark.range(20_000).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 5).alias("b"), F.lit(7).alias("c"))
    wide, few, constant = boosting.bin_cuts(rows, ["a", "b", "c"], 64)
    assert len(wide) == 63 and np.abs(wide / 20_000 - np.arange(1, 64) / 64).max() < 0.001
    assert few.tolist() == [0, 1, 2, 3] and len(constant) == 0
    with pytest.raises(ValueError):
        boosting.bin_cuts(rows, ["a"], 1000)


def test_missing_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (None, 5.0, 1.0), (2.0, None, 2.0), (1.0, 4.0, 3.0)], "x0 double, y double, spare double")
    model = fit(df, ["x0"], rounds=3)
    assert (model.rows, model.base) == (2, 3.0) and all(t.feature[0] == -1 for t in model.trees)
    assert model.transform(df).filter("prediction is null").isEmpty()
    with pytest.raises(ValueError, match="no rows"):
        fit(df.limit(0), ["x0"])
    assert predictions(fit(df, ["x0"], rounds=0), df).tolist() == [3.0] * 4


def test_saved_and_as_arrays(spark, tmp_path, monkeypatch):
    x, y = data()
    df, names = table(spark, x, y)
    model = fit(df, names, rounds=5, depth=3)
    model.save(spark, str(tmp_path / "m"))
    model.save(spark, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert again.settings == model.settings and again.features == names
    assert np.array_equal(predictions(model, df), predictions(again, df))
    monkeypatch.setattr(scorers, "FEATURE_COLS", names)
    whole = scorers.scorer_of(spark, model)
    monkeypatch.setattr(scorers, "GROUP_NODES", 20)
    parts = scorers.scorer_of(spark, model)
    assert len(whole.groups) == 1 and len(parts.groups) == 5
    assert np.allclose(whole.predict(x), predictions(model, df)) and np.allclose(parts.predict(x), predictions(model, df))
    phi, base = attribution.shapley_values(whole.groups[0].value, x)
    assert np.allclose(base + phi.sum(axis=1), predictions(model, df))


def same_trees(one, other):
    return len(one.trees) == len(other.trees) and all(
        np.array_equal(getattr(a, name), getattr(b, name))
        for a, b in zip(one.trees, other.trees, strict=True)
        for name in ("feature", "cut", "threshold", "value", "cover")
    )


def test_a_level_is_one_stage_and_some_blocks_are_one_task(spark, monkeypatch):
    """Each Python stage has its wait: a level of a tree is one, and a table of a few blocks needs no jobs at all."""
    x, y = data(1500)
    df, names = table(spark, x, y, 7)
    settings = {"rounds": 4, "depth": 3, "row_share": 0.7, "column_share": 0.6}
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    parts, loaded = [], boosting._loaded
    monkeypatch.setattr(boosting, "_loaded", lambda *a: (parts.append(loaded(*a)), parts[-1])[1])
    one = fit(df, names, **settings)
    assert {p.getNumPartitions() for p in parts} == {1}
    parts.clear()
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "MOVE_ROUNDS", 2)
    jobs, grown, context = [], boosting._Growth.grown, spark.sparkContext

    def counted(self, *args):
        context.setJobGroup(f"tree {self.round}", "")
        tree = grown(self, *args)
        tracker = context.statusTracker()
        for job in tracker.getJobIdsForGroup(f"tree {self.round}"):
            stages = [tracker.getStageInfo(k) for k in tracker.getJobInfo(job).stageIds]
            # Those that are not run again have no tasks.
            jobs.append(sum(k is not None and k.numCompletedTasks > 0 for k in stages))
        context.setLocalProperty("spark.jobGroup.id", None)
        return tree

    monkeypatch.setattr(boosting._Growth, "grown", counted)
    many = fit(df, names, **settings)
    assert parts[0].getNumPartitions() > 1 and jobs == [1] * 12
    monkeypatch.setattr(boosting, "MEET", 2)
    met = fit(df, names, **settings)
    assert same_trees(one, many) and same_trees(one, met)


def test_only_the_smaller_child_is_summed():
    growth = boosting._Growth([], 0, np.array([4, 3]), 1.0, Settings(depth=2, column_share=1.0))
    rng = np.random.default_rng(0)
    bins = np.stack([rng.integers(0, 4, 500), rng.integers(0, 3, 500)]).astype(np.uint8)
    gradient = rng.integers(-9, 9, 500).astype(float)
    tree = boosting.Tree.empty(2)
    tree.feature[0], tree.cut[0] = 0, 0
    left = bins[0] == 0
    tree.cover[[1, 2]] = left.sum(), (~left).sum()
    assert growth.summed_nodes(tree, 1).tolist() == [1]
    drawn = (bins, gradient)
    sums = lambda nodes, level: growth.sums([(drawn, growth.placed(drawn, tree, level))], nodes, 2)
    whole = growth.completed(sums(np.array([1]), 1), tree, 1, sums(np.array([0]), 0))
    assert np.array_equal(whole, sums(np.array([1, 2]), 1))
    assert whole[1, 1].sum() == 2 * (~left).sum()


def test_blocks_are_dealt_out_evenly(spark, monkeypatch):
    """A job for each level waits for its last task: nine partitions on eight cores took two turns, uneven ones the longest."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    uneven = spark.createDataFrame([(k,) for k in range(90)], "k int").repartitionByRange(9, "k")
    blocks = boosting._blocks(
        uneven.select("k", F.explode(F.sequence(F.lit(1), F.when(F.col("k") < 80, 30).otherwise(3000))).alias("y")),
        ["y"], "y", [np.array([5.0])], 0.0,
    )
    rows = 80 * 30 + 10 * 3000
    loaded = boosting._loaded(blocks, rows)
    sizes = loaded.mapPartitions(lambda part: [sum(len(b[1]) for b in part)]).collect()
    loaded.unpersist()
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) == cores and sum(sizes) == rows and max(sizes) < 1.3 * rows / cores
    monkeypatch.setattr(boosting, "TASK_ROWS", rows // (3 * cores))
    assert boosting._loaded(blocks, rows).getNumPartitions() == 3 * cores


def test_prediction_does_not_depend_on_how_rows_are_cut(monkeypatch):
    from skygauge.operators import trees

    rng = np.random.default_rng(0)
    made = []
    for _ in range(30):
        t = boosting.Tree.empty(4)
        t.feature[:15], t.threshold[:15], t.value[:] = rng.integers(-1, 5, 15), rng.normal(size=15), rng.normal(size=31)
        made.append(t)
    model = boosting.BoostedTrees([f"f{k}" for k in range(5)], 1.0, 10, made, Settings(depth=4))
    x = rng.normal(size=(300, 5))
    x[::7, 2] = np.nan
    want = np.full(300, 1.0)
    for t in made:
        for r in range(300):
            i = 0
            while t.feature[i] >= 0:
                i = 2 * i + 1 if x[r, t.feature[i]] <= t.threshold[i] else 2 * i + 2
            want[r] += t.value[i]
    got = model.scorer().predict(x)
    assert np.allclose(got, want, rtol=1e-12)
    monkeypatch.setattr(trees, "CELLS_AT_ONCE", 1)
    assert np.array_equal(model.scorer().predict(x), got)
