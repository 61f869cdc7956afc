"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and
the cores. Every query is computed in full and its rows are discarded.
"""

from __future__ import annotations

import json
import os
import time

from skygauge import get_spark
from skygauge.plans.queries import QUERIES

HEADLINE = [
    "hourly_readings",
    "payload_flatten",
    "merge_weather",
    "union_dedup",
    "aqi_pm25_2024",
    "aqi_composite",
    "aqi_category",
    "interpolate",
    "station_quantiles",
    "percentile_clip",
    "lag_features",
    "rolling_features",
    "featured_table",
    "regression_metrics",
    "recursive_forecast",
    "recursive_backtest",
    "linear_attribution",
    "current_conditions",
    "live_stream",
    "train_ridge",
    "train_boosting",
    "tree_shap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "skygauge-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
