"""Fitted models as plain arrays, for use inside Spark tasks."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.ml.regression import (
    GBTRegressionModel,
    LinearRegressionModel,
    RandomForestRegressionModel,
)
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skygauge.operators.boosting import BoostedTrees
from skygauge.operators.forest import ForestTrees
from skygauge.operators.trees import TreeScorer, tree_groups
from skygauge.schemas import FEATURE_COLS
from skygauge.session import scratch_path

# Trees are sent in groups of about so many nodes, 44 bytes each; a larger tree is a group.
GROUP_NODES = 1_000_000


@dataclass
class LinearScorer:
    coefficients: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coefficients + self.intercept


@dataclass
class SharedTrees:
    """An ensemble of any size, as broadcast groups of trees; predictions add up over groups."""

    groups: list[Broadcast]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for group in self.groups:
            total += group.value.predict(x)
        return total


Scorer = LinearScorer | TreeScorer | SharedTrees


def _core(model):
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def _inputs(model) -> list[str]:
    if isinstance(model, (BoostedTrees, ForestTrees)):
        return model.features
    return model.stages[0].getInputCols() if isinstance(model, PipelineModel) else FEATURE_COLS


def is_tree_model(model) -> bool:
    return isinstance(_core(model), (BoostedTrees, ForestTrees, GBTRegressionModel, RandomForestRegressionModel))


def has_arrays(model) -> bool:
    """``scorer_of`` knows this kind of model."""
    return is_tree_model(model) or isinstance(_core(model), LinearRegressionModel)


def scorer_of(spark: SparkSession, model) -> LinearScorer | SharedTrees:
    """Arrays of a fitted linear, forest or boosting model of any size."""
    core = _core(model)
    if isinstance(core, LinearRegressionModel):
        fitted = dict(zip(_inputs(model), core.coefficients.toArray()))
        coefficients = np.array([fitted.get(f, 0.0) for f in FEATURE_COLS])
        return LinearScorer(coefficients, float(core.intercept))
    if not is_tree_model(core):
        raise TypeError(f"no array form of {type(core).__name__}")
    if isinstance(core, BoostedTrees):
        return _share_boosted(spark, core)
    if isinstance(core, ForestTrees):
        return _share_forest(spark, core)
    weights = np.asarray(core.treeWeights, dtype=float)
    if isinstance(core, RandomForestRegressionModel):
        weights = weights / weights.sum()
    return _read_trees(spark, core, weights)


def _share_boosted(spark: SparkSession, model: BoostedTrees) -> SharedTrees:
    at = np.array([FEATURE_COLS.index(f) for f in model.features], np.int32)
    size = len(model.trees[0].feature) if model.trees else 1
    groups = []
    for first, last in _tree_groups(dict.fromkeys(range(len(model.trees)), size)) or [(0, -1)]:
        trees = model.scorer(model.trees[first : last + 1], with_base=first == 0)
        trees.feature = at[trees.feature]
        groups.append(spark.sparkContext.broadcast(trees))
    return SharedTrees(groups)


def _share_forest(spark: SparkSession, model: ForestTrees) -> SharedTrees:
    at = np.array([FEATURE_COLS.index(f) for f in model.features], np.int32)
    return SharedTrees([spark.sparkContext.broadcast(replace(g, feature=at[g.feature])) for g in model.groups(GROUP_NODES)])


def _tree_groups(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """(first, last) of runs of trees with about ``GROUP_NODES`` nodes."""
    return tree_groups(sizes, GROUP_NODES)


def _read_trees(spark: SparkSession, core, weights: np.ndarray) -> SharedTrees:
    """Through the saved form of the model, which holds the rows seen by every node.

    The driver holds one group at a time.
    """
    path = scratch_path(spark, "model")
    core.write().save(path)
    node = F.col("nodeData")
    saved = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("id"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["split"]["numCategories"].alias("categories"),
        node["prediction"].alias("value"),
        node["rawCount"].cast("double").alias("cover"),
    )
    # One row for each tree.
    sizes = {r["tree"]: r["count"] for r in saved.groupBy("tree").count().collect()}
    groups = []
    for first, last in _tree_groups(sizes):
        nodes = saved.filter(F.col("tree").between(first, last)).toPandas()
        trees = _arrays(nodes.sort_values(["tree", "id"]), weights[first : last + 1])
        groups.append(spark.sparkContext.broadcast(trees))
    return SharedTrees(groups)


def _arrays(nodes: pd.DataFrame, weights: np.ndarray) -> TreeScorer:
    if (nodes["categories"] > 0).any():
        raise TypeError("categorical splits are not used here")
    sizes = nodes.groupby("tree").size().to_numpy()
    roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
    first = np.repeat(roots, sizes)
    leaf = (nodes["left"] < 0).to_numpy()
    here = np.arange(len(nodes))
    left = np.where(leaf, here, nodes["left"].to_numpy() + first).astype(np.int32)
    right = np.where(leaf, here, nodes["right"].to_numpy() + first).astype(np.int32)
    return TreeScorer(
        feature=np.where(leaf, 0, nodes["feature"].to_numpy()).astype(np.int32),
        threshold=np.where(leaf, np.inf, nodes["threshold"].to_numpy(dtype=float)),
        left=left,
        right=right,
        value=nodes["value"].to_numpy(),
        cover=nodes["cover"].to_numpy(),
        roots=roots,
        weights=weights,
        depth=_depth(left, right, roots),
    )


def _depth(left: np.ndarray, right: np.ndarray, roots: np.ndarray) -> int:
    level, depth = roots, 0
    while True:
        inner = level[left[level] != level]
        if not len(inner):
            return depth
        level, depth = np.concatenate([left[inner], right[inner]]), depth + 1
