"""Regression metrics and model selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.functions.numeric import round_binary


def regression_metrics(
    scored: DataFrame, actual: str = "pm2_5", predicted: str = "prediction", by: tuple[str, ...] = ()
) -> DataFrame:
    """mae, rmse, r2 and n per group, in one aggregate; r2 is null for a constant target."""
    y, p = F.col(actual), F.col(predicted)
    error = y - p
    squares = F.sum(error * error)
    known = scored.filter(y.isNotNull() & p.isNotNull())
    return known.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(squares, F.var_pop(y) * F.count(y))).alias("r2"),
        F.count(y).alias("n"),
    )


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    present = [c for c in ("mae", "rmse", "r2") if c in metrics.columns]
    return metrics.withColumns({c: round_binary(F.col(c), 3) for c in present})


def select_model(metrics: DataFrame) -> DataFrame:
    """The row with the lowest rounded MAE; the first listed (``ordinal``) on ties."""
    return metrics.orderBy(round_binary(F.col("mae"), 3), "ordinal").limit(1)
