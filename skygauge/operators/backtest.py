"""Rolling-origin backtest of the recursive forecast."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.operators.features import positioned
from skygauge.operators.forecast import explode_paths, paths_for_model, with_recent
from skygauge.operators.series import LENGTH, POS, stride_sample
from skygauge.schemas import STATION, TARGET

HORIZONS = {"24hr": 24, "48hr": 48, "72hr": 72}
ORIGIN_STEP = 10
MAX_ORIGINS = 50


def backtest_origins(
    featured: DataFrame,
    horizons: list[int] | None = None,
    train_share: float = 0.8,
    step: int = ORIGIN_STEP,
    at_most: int = MAX_ORIGINS,
) -> DataFrame:
    """Every ``step``-th row of each station's test part, the first ``at_most``.

    ``reach`` is the longest horizon that still has all its actual values. The origins of a
    longer horizon are among those of a shorter one, so the union is the shortest one's.
    """
    horizons = sorted(horizons or HORIZONS.values())
    rows = positioned(featured)
    start = F.floor(F.col(LENGTH) * F.lit(train_share))
    origins = stride_sample(rows, start, F.col(LENGTH) - horizons[0], step, at_most)
    fits = [F.when(F.col(POS) < F.col(LENGTH) - h, F.lit(h)) for h in horizons]
    return origins.withColumn("reach", F.greatest(*fits, F.lit(0)))


def align_actuals(predictions: DataFrame, featured: DataFrame) -> DataFrame:
    """Adds the observed value ``horizon_hour`` rows after the origin (``pos``)."""
    reach = predictions.groupBy(STATION).agg(
        F.min(POS).alias("_from"), F.max(F.col(POS) + F.col("horizon_hour")).alias("_to")
    )
    # Only rows that a prediction can reach are shuffled for the join by position.
    actuals = (
        positioned(featured)
        .select(STATION, F.col(POS).alias("_at"), F.col(TARGET).alias("actual"))
        .join(reach, STATION)
        .filter(F.col("_at").between(F.col("_from"), F.col("_to")))
        .drop("_from", "_to")
    )
    shifted = predictions.withColumn("_at", F.col(POS) + F.col("horizon_hour"))
    return shifted.join(actuals, [STATION, "_at"]).drop("_at")


def horizon_mae(
    aligned: DataFrame, horizons: dict[str, int] | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """Mean over origins of each origin's MAE, per horizon.

    ``aligned``: station, pos, reach, horizon_hour, predicted, actual. A horizon without
    origins has a null MAE.
    """
    spark = aligned.sparkSession
    horizons = HORIZONS if horizons is None else horizons
    lengths = F.array(*[F.lit(h) for h in horizons.values()])
    served = F.filter(lengths, lambda h: (F.col("horizon_hour") <= h) & (h <= F.col("reach")))
    per_horizon = aligned.withColumn("horizon_hours", F.explode(served))
    per_origin = per_horizon.groupBy(STATION, POS, "horizon_hours").agg(
        F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae")
    )
    means = per_origin.groupBy(*by, "horizon_hours").agg(
        F.avg("mae").alias("mae"), F.count("*").alias("n_origins")
    )
    if by:
        return means
    labels = spark.createDataFrame(list(horizons.items()), "label string, horizon_hours int")
    return labels.join(means, "horizon_hours", "left").select(
        "label", "horizon_hours", "mae", F.coalesce("n_origins", F.lit(0)).alias("n_origins")
    )


def recursive_backtest(
    model: PipelineModel,
    featured: DataFrame,
    horizons: dict[str, int] | None = None,
    train_share: float = 0.8,
    step: int = ORIGIN_STEP,
    at_most: int = MAX_ORIGINS,
    **options: str,
) -> DataFrame:
    """Forecast once to the longest horizon; shorter ones are prefixes of the same path.

    Origins as in ``backtest_origins``; ``options`` as in ``forecast.paths_for_model``.
    """
    horizons = HORIZONS if horizons is None else horizons
    rows = positioned(featured)
    source = positioned(with_recent(rows)) if options.get("lags") == "exact" else rows
    origins = backtest_origins(source, list(horizons.values()), train_share, step, at_most)
    paths = paths_for_model(model, origins, max(horizons.values()), (POS, "reach"), **options)
    return horizon_mae(align_actuals(explode_paths(paths), rows), horizons)
