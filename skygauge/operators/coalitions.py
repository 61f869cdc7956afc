"""Attribution of any model's predictions by sampled coalitions of features.

A coalition is the set of features that are known; the others are those of a background row. What a coalition is worth
for a row is the mean prediction over the background. Shapley values are the weighted least-squares fit of these worths
by one number per feature, under the condition that all numbers add up to the prediction's distance from the base.

All rows are explained with the same coalitions, so the fit is one fixed matrix: a contribution is the sum of
worths times weights, an aggregate with a partial step. A row is expanded to ``coalitions x background`` rows, both
parameters, and any model that transforms a DataFrame scores them; nothing is gathered.

* Up to ``budget`` coalitions are enumerated if there are no more of them: the values are exact then. Otherwise they are
  drawn in pairs (a set and its complement), sizes by the Shapley kernel, in BATCHES independent batches.
* ``bound`` is a bound on the error of the sampling: the batches' estimates spread around their mean, and the bound is
  Student's quantile for CONFIDENCE times the standard error of that mean. It is 0 where coalitions are
  enumerated, and rounding where a model is additive, as each batch alone finds the values then.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.schemas import FEATURE_COLS, STATION, TIMESTAMP

BUDGET = 2048
BACKGROUND_ROWS = 32
BATCHES = 8
# Two-sided 99.9 % quantile of Student's distribution with BATCHES - 1 degrees of freedom.
CONFIDENCE = 5.408


def enumerated(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All coalitions but the empty and the full one (rows of 0 and 1), with their kernel weights."""
    sets, weights = [], []
    for size in range(1, n):
        for chosen in combinations(range(n), size):
            sets.append([k in chosen for k in range(n)])
            weights.append((n - 1) / (comb(n, size) * size * (n - size)))
    return np.array(sets, float).reshape(-1, n), np.array(weights)


def drawn(n: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``count`` coalitions by the Shapley kernel, sets and complements; equal weights."""
    rng = np.random.default_rng([seed, n])
    sizes = np.arange(1, n)
    share = 1.0 / (sizes * (n - sizes))
    sets = np.zeros((count, n))
    for k in range(0, count - 1, 2):
        sets[k, rng.permutation(n)[: rng.choice(sizes, p=share / share.sum())]] = 1
        sets[k + 1] = 1 - sets[k]
    if count % 2:
        sets[-1, rng.permutation(n)[: n // 2]] = 1
    return sets, np.ones(count)


def solver(sets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(features x coalitions + 1): contributions from the worths of the coalitions less the base, and from the
    prediction less the base (last column).

    The condition on the sum takes the last feature's place.
    """
    n = sets.shape[1]
    if n == 1:
        return np.ones((1, 1 + len(sets))) * np.append(np.zeros(len(sets)), 1.0)
    free = sets[:, :-1] - sets[:, -1:]
    root = np.sqrt(weights)[:, None]
    # (free' W free)^-1 free' W, by pseudo-inverse: a direction no coalition tells of gets nothing.
    fit = np.linalg.pinv(free * root) * root.T
    by_total = -fit @ sets[:, -1]
    out = np.empty((n, len(sets) + 1))
    out[:-1, :-1], out[:-1, -1] = fit, by_total
    out[-1, :-1], out[-1, -1] = -fit.sum(axis=0), 1 - by_total.sum()
    return out


def _plan(n: int, budget: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each batch its coalitions, the full one last, and their solver."""
    if n == 1 or 2**n - 2 <= budget:
        batches = [enumerated(n)]
    else:
        size = max(2 * n, budget // BATCHES)
        batches = [drawn(n, size, seed * 1000 + batch) for batch in range(BATCHES)]
    return [(np.vstack([sets, np.ones((1, n))]), solver(sets, weights)) for sets, weights in batches]


def background_rows(rows: DataFrame, features: list[str], count: int = BACKGROUND_ROWS, seed: int = 42) -> list[tuple]:
    """``count`` rows to stand for the features that are not known, the same on every run."""
    key = F.md5(F.concat_ws("|", STATION, F.col(TIMESTAMP).cast("string"), F.lit(f"background {seed}")))
    chosen = rows.orderBy(key, STATION, TIMESTAMP).limit(count)
    return [tuple(float(v) for v in r) for r in chosen.select(*features).collect()]


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def coalition_attribution(
    model,
    rows: DataFrame,
    background: list[tuple],
    features: list[str] = FEATURE_COLS,
    budget: int = BUDGET,
    seed: int = 42,
) -> DataFrame:
    """(station, timestamp, base, contributions, bound): base + sum(contributions) = prediction.

    ``model`` is anything whose ``transform`` adds ``prediction``; ``background`` has one value for each of
    ``features`` in each row. Rows are told apart by station and timestamp. An empty table gives no rows.
    """
    if not background:
        raise ValueError("an explanation needs background rows")
    spark = rows.sparkSession
    n = len(features)
    # Coalitions by number, 0 for the empty one, with their weights; those of the empty one make up for all others.
    masks, table = [0], []
    for batch, (sets, weights) in enumerate(_plan(n, budget, seed)):
        table.append((0, batch, (-weights.sum(axis=1)).tolist()))
        for known, weight in zip(sets, weights.T, strict=True):
            table.append((len(masks), batch, weight.tolist()))
            masks.append(int(sum(1 << int(j) for j in np.flatnonzero(known))))
    # Bit j of a coalition's mask says that feature j is known. All tables are bounded by parameters.
    where = F.array(*[F.lit(m).cast("long") for m in masks])
    known = lambda j: F.shiftright("mask", j).bitwiseAND(F.lit(1)) == 1
    own = [F.col(f).cast("double").alias(f"_x{j}") for j, f in enumerate(features)]
    others = [_doubles(b[j] for b in background) for j in range(len(features))]
    expanded = (
        rows.select(STATION, TIMESTAMP, *own)
        .select("*", F.posexplode(where).alias("coalition", "mask"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(len(background) - 1))).alias("_b"))
        .select(
            STATION, TIMESTAMP, "coalition",
            *[F.when(known(j), F.col(f"_x{j}")).otherwise(F.get(others[j], F.col("_b"))).alias(f) for j, f in enumerate(features)],
        )
    )
    worth = model.transform(expanded).groupBy(STATION, TIMESTAMP, "coalition").agg(F.avg("prediction").alias("worth"))
    weights = spark.createDataFrame(table, "coalition int, batch int, weights array<double>")
    estimates = (
        worth.join(F.broadcast(weights), "coalition")
        .groupBy(STATION, TIMESTAMP, "batch")
        .agg(
            F.max(F.when(F.col("coalition") == 0, F.col("worth"))).alias("base"),
            *[F.sum(F.col("worth") * F.col("weights")[j]).alias(f"s{j}") for j in range(n)],
        )
    )
    error = lambda j: F.coalesce(F.stddev_samp(f"s{j}") * CONFIDENCE / F.sqrt(F.count("*")), F.lit(0.0))
    return estimates.groupBy(STATION, TIMESTAMP).agg(
        F.max("base").alias("base"),
        F.array(*[F.avg(f"s{j}") for j in range(n)]).alias("contributions"),
        F.array(*[error(j) for j in range(n)]).alias("bound"),
    )
