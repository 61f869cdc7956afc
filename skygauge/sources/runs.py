"""History of model runs: an append-only log of metrics, and views of it.

Each run adds rows of its own and changes none. A row is a model's metrics or a horizon's error; ``winner`` marks the
model that was selected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygauge.operators.evaluate import select_model

LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("logged_at", T.TimestampNTZType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("horizon_hours", T.IntegerType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("winner", T.BooleanType()),
    ]
)


def _stamped(rows: DataFrame, run_id: str, at: dt.datetime, kind: str) -> DataFrame:
    stamped = rows.withColumns({"run_id": F.lit(run_id), "logged_at": F.lit(at).cast("timestamp_ntz"), "kind": F.lit(kind)})
    known = set(stamped.columns)
    return stamped.select(
        *[(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG.fields]
    )


def log_models(metrics: DataFrame, path: str, run_id: str, at: dt.datetime) -> None:
    """Adds a run's model metrics (model, ordinal, mae, rmse, r2) and its winner."""
    won = select_model(metrics).select(F.col("ordinal").alias("_won"))
    # One row.
    marked = metrics.join(F.broadcast(won), F.col("ordinal") == F.col("_won"), "left").withColumn("winner", F.col("_won").isNotNull())
    _append(_stamped(marked.withColumnRenamed("model", "name"), run_id, at, "model"), path)


def log_horizons(errors: DataFrame, path: str, run_id: str, at: dt.datetime) -> None:
    """Adds a run's backtest errors (label, horizon_hours, mae)."""
    _append(_stamped(errors.withColumnRenamed("label", "name"), run_id, at, "horizon"), path)


def _append(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All runs. A run that was logged twice (a retried job) counts once."""
    return spark.read.schema(LOG).parquet(path).distinct()


def latest_run(spark: SparkSession, path: str, kind: str = "model") -> DataFrame:
    """Rows of the run logged last; of runs at the same time, the last name."""
    rows = history(spark, path).filter(F.col("kind") == kind)
    last = rows.agg(F.max(F.struct("logged_at", "run_id")).alias("_last"))
    return rows.join(F.broadcast(last), F.struct("logged_at", "run_id") == F.col("_last")).drop("_last")


def winners(spark: SparkSession, path: str) -> DataFrame:
    """run_id, logged_at and the winner's name of every run."""
    return history(spark, path).filter("winner").select("run_id", "logged_at", "name")
