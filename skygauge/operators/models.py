"""Ridge, random forest and gradient boosting on the feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygauge.operators.boosting import BoostedTrees, HistogramBoosting, Settings
from skygauge.operators.evaluate import regression_metrics, select_model
from skygauge.operators.forest import ForestTrees, HistogramForest
from skygauge.operators.series import chronological_split
from skygauge.schemas import FEATURE_COLS, MODEL_METRICS, STATION, TARGET, TIMESTAMP
from skygauge.session import ensure_checkpoint_dir, stage
from skygauge.sources import files

RIDGE = "Ridge Regression"
FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"


def assembler(features: list[str] = FEATURE_COLS) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def ridge(train: DataFrame, alpha: float = 1.0, target: str = TARGET) -> LinearRegression:
    """Penalty ``alpha * |w|^2`` on the sum of squared errors, free intercept.

    Spark minimizes the mean over rows of the error scaled by the label's deviation, hence
    the conversion of ``alpha``.
    """
    stats = train.agg(F.stddev_pop(target).alias("sd"), F.count(target).alias("n")).first()
    return LinearRegression(
        labelCol=target,
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        regParam=alpha * stats["sd"] / stats["n"],
    )


def forest(
    trees: int = 200, depth: int = 15, min_leaf: int = 5, seed: int = 42, target: str = TARGET
) -> HistogramForest:
    return HistogramForest(
        labelCol=target,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="all",
        maxBins=256,
        seed=seed,
    )


def boosting(
    rounds: int = 300,
    rate: float = 0.05,
    depth: int = 6,
    row_share: float = 0.8,
    column_share: float = 0.8,
    seed: int = 42,
    target: str = TARGET,
    **more: float,
) -> HistogramBoosting:
    """``more``: penalty, least_weight, least_gain, bins of ``boosting.Settings``."""
    return HistogramBoosting(Settings(rounds, rate, depth, row_share, column_share, seed=seed, **more), target)


Fitted = PipelineModel | BoostedTrees | ForestTrees


def default_models(train: DataFrame) -> dict[str, Estimator | HistogramBoosting]:
    return {RIDGE: ridge(train), FOREST: forest(), BOOSTING: boosting()}


def varying(train: DataFrame, features: list[str]) -> list[str]:
    """Features with more than one value."""
    ends = train.agg(*[(F.min(f) < F.max(f)).alias(f) for f in features]).first()
    return [f for f in features if ends[f]]


def fit(train: DataFrame, estimator: Estimator | HistogramBoosting, features: list[str] = FEATURE_COLS) -> Fitted:
    """Constant features (the month of a short series) are left out of a linear fit.

    Their ridge coefficient is 0, but Spark does not penalize a column without variance and
    meets a singular matrix.
    """
    ensure_checkpoint_dir(train.sparkSession)
    if isinstance(estimator, HistogramBoosting):
        return estimator.fit(train, features)
    if isinstance(estimator, HistogramForest):
        return estimator.fit_trees(train, features)
    if isinstance(estimator, LinearRegression):
        features = varying(train, features)
    return Pipeline(stages=[assembler(features), estimator]).fit(train)


def score(model: Fitted, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("features")


def split_for_training(featured: DataFrame, train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """First part of every station for training, the rest for testing.

    Staged, as every fit reads it several times; the columns are those a model needs.
    """
    columns = list(dict.fromkeys([STATION, TIMESTAMP, TARGET, *FEATURE_COLS]))
    parts = stage(chronological_split(featured.select(*columns), train_share), "split")
    return parts.filter("is_train"), parts.filter("not is_train")


@dataclass
class Comparison:
    """Metrics of all models, the fitted models and the winner's name."""

    metrics: DataFrame
    models: dict[str, Fitted]
    winner: str


def train_and_compare(
    featured: DataFrame, estimators: dict[str, Estimator | HistogramBoosting] | None = None, train_share: float = 0.8
) -> Comparison:
    """Fit every model on the same training rows and compare them on the same test rows."""
    spark = featured.sparkSession
    train, test = split_for_training(featured, train_share)
    estimators = default_models(train) if estimators is None else estimators
    models, rows = {}, []
    for ordinal, (name, estimator) in enumerate(estimators.items()):
        models[name] = fit(train, estimator)
        found = regression_metrics(score(models[name], test)).first()
        rows.append((name, ordinal, found["mae"], found["rmse"], found["r2"]))
    metrics = spark.createDataFrame(rows, MODEL_METRICS)
    return Comparison(metrics, models, select_model(metrics).first()["model"])


def save_model(model: Fitted, path: str) -> None:
    if isinstance(model, (BoostedTrees, ForestTrees)):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> Fitted:
    spark = SparkSession.active()
    if not files.exists(spark, f"{path}/nodes"):
        return PipelineModel.load(path)
    forest = "draws" in spark.read.parquet(f"{path}/nodes").columns
    return (ForestTrees if forest else BoostedTrees).load(spark, path)
