"""Attribution by coalitions against the definition of Shapley values."""

import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from skygauge.operators import attribution, coalitions

NAMES = ["a", "b", "c", "d", "e"]


class Own:
    """Any model: only ``transform`` is asked of it."""

    def __init__(self, prediction):
        self.prediction = prediction

    def transform(self, df):
        return df.withColumn("prediction", F.expr(self.prediction))


def f(x):
    a, b, c, d, e = x
    return (7.0 if a > 0 and b <= 0.5 else -2.0) + (c * d if d > 0 else e)


TREE_LIKE = Own("if(a > 0 and b <= 0.5, 7D, -2D) + if(d > 0, c * d, e)")


def shapley(x, background):
    """By all orders: the worth of a set is the mean over the background."""
    n = len(x)
    worth = lambda s: np.mean([f([x[j] if j in s else b[j] for j in range(n)]) for b in background])
    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(others, k):
                phi[i] += factorial(k) * factorial(n - k - 1) / factorial(n) * (worth({*s, i}) - worth(set(s)))
    return phi


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    return rng.normal(size=(12, 5)), [tuple(r) for r in rng.normal(size=(6, 5)).tolist()]


@pytest.fixture(scope="module")
def rows(spark, values):
    at = dt.datetime(2025, 1, 1)
    data = [(f"S{k}", at, *map(float, r)) for k, r in enumerate(values[0])]
    return spark.createDataFrame(data, "station string, timestamp timestamp_ntz, " + ", ".join(f"{n} double" for n in NAMES))


def collected(df):
    found = {r.station: r for r in df.collect()}
    return [found[f"S{k}"] for k in range(len(found))]


def test_enumerated_coalitions_are_exact(values, rows):
    x, background = values
    for r, own in zip(collected(coalitions.coalition_attribution(TREE_LIKE, rows, background, NAMES)), x, strict=True):
        assert np.allclose(r.contributions, shapley(own, background), atol=1e-9) and set(r.bound) == {0.0}
        assert r.base + sum(r.contributions) == pytest.approx(f(own))


def test_drawn_coalitions_are_within_their_bound(values, rows):
    """A budget below the number of coalitions; the sum holds anyway."""
    x, background = values
    inside, widths = [], []
    for r, own in zip(collected(coalitions.coalition_attribution(TREE_LIKE, rows, background, NAMES, budget=24)), x, strict=True):
        error = np.abs(np.array(r.contributions) - shapley(own, background))
        inside += (error <= np.array(r.bound) + 1e-9).tolist()
        widths += r.bound
        assert r.base + sum(r.contributions) == pytest.approx(f(own))
    assert np.mean(inside) > 0.95 and 0 < np.mean(widths) < 10


def test_more_coalitions_narrow_the_bound():
    rng = np.random.default_rng(1)
    pairs = rng.normal(size=(10, 10))
    worth = lambda sets: np.einsum("ki,ij,kj->k", sets, pairs, sets)
    exact, weights = coalitions.enumerated(10)
    total = pairs.sum()
    want = coalitions.solver(exact, weights) @ np.append(worth(exact), total)
    assert np.allclose(want, (pairs.sum(axis=0) + pairs.sum(axis=1)) / 2)
    errors = []
    for count in (40, 400, 4000):
        sets, equal = coalitions.drawn(10, count, 3)
        errors.append(np.abs(coalitions.solver(sets, equal) @ np.append(worth(sets), total) - want).max())
    # A game of pairs is found exactly from sets with their complements.
    assert max(errors) < 1e-9


def test_additive_model_with_many_features(spark):
    names = [f"x{k}" for k in range(30)]
    rng = np.random.default_rng(4)
    weights, x = rng.normal(size=30), rng.normal(size=(3, 30))
    background = [tuple(r) for r in rng.normal(size=(4, 30)).tolist()]
    at = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(f"S{k}", at, *map(float, r)) for k, r in enumerate(x)], "station string, timestamp timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    model = Own(" + ".join(["1D", *[f"{n} * ({float(w)!r})" for n, w in zip(names, weights, strict=True)]]))
    for r, own in zip(collected(coalitions.coalition_attribution(model, df, background, names, budget=600)), x, strict=True):
        assert np.allclose(r.contributions, weights * (own - np.mean(background, axis=0)), atol=1e-8)
        assert max(r.bound) < 1e-8


def test_one_feature_no_rows_no_background(spark, rows, values):
    only = coalitions.coalition_attribution(Own("a * 3"), rows.select("station", "timestamp", "a"), [(1.0,)], ["a"])
    for r, own in zip(collected(only), values[0], strict=True):
        assert r.base == 3.0 and r.contributions == pytest.approx([3 * own[0] - 3])
    assert coalitions.coalition_attribution(TREE_LIKE, rows.limit(0), values[1], NAMES).isEmpty()
    with pytest.raises(ValueError, match="background"):
        coalitions.coalition_attribution(TREE_LIKE, rows, [], NAMES)


def test_any_model_is_explained(rows):
    found = attribution.attribute(TREE_LIKE, rows, features=NAMES)
    assert found.columns == ["station", "timestamp", "feature", "contribution"] and found.count() == 12 * 5
    assert attribution.attribute(TREE_LIKE, rows.limit(0), features=NAMES).isEmpty()
