import datetime as dt

from skygauge.schemas import HORIZON_METRICS, MODEL_METRICS
from skygauge.sources import runs


def test_history_of_runs(spark, tmp_path):
    path = str(tmp_path / "log")
    metrics = lambda *mae: spark.createDataFrame([(m, k, v, 1.0, 0.5) for k, (m, v) in enumerate(zip("abc", mae))], MODEL_METRICS)
    runs.log_models(metrics(0.9, 0.70049, 0.70041), path, "one", dt.datetime(2025, 1, 1))
    runs.log_models(metrics(0.1, 0.2, 0.3), path, "two", dt.datetime(2025, 1, 2))
    runs.log_models(metrics(0.1, 0.2, 0.3), path, "two", dt.datetime(2025, 1, 2))  # a retried job
    horizons = spark.createDataFrame([("24hr", 24, 1.5), ("72hr", 72, None)], HORIZON_METRICS)
    runs.log_horizons(horizons, path, "two", dt.datetime(2025, 1, 3))
    assert runs.history(spark, path).schema == runs.LOG and runs.history(spark, path).count() == 8
    # Equal rounded errors: the first listed wins.
    assert {(r.run_id, r.name) for r in runs.winners(spark, path).collect()} == {("one", "b"), ("two", "a")}
    latest = runs.latest_run(spark, path).collect()
    assert {r.run_id for r in latest} == {"two"} and len(latest) == 3
    ahead = {r.name: (r.horizon_hours, r.mae, r.winner) for r in runs.latest_run(spark, path, "horizon").collect()}
    assert ahead == {"24hr": (24, 1.5, None), "72hr": (72, None, None)}
