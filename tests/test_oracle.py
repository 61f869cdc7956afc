"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

# These run the whole chain up to the feature table; some stand for the rest here, and all
# of them are compared by the driver.
SLOW = {
    "median_fill", "percentile_clip", "aqi_stats", "chrono_split", "regression_metrics",
    "select_model", "backtest_origins", "backtest_mae", "forecast_sample", "linear_attribution",
    "sampled_rows", "current_conditions_model", "next_24h", "full_72h", "pollutant_limits",
}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return str(value)


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n not in SLOW])
def test_query_equals_sql(spark, tables, name):
    found = queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    relation = tables.execute(oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    rows = relation.fetchall()
    expected = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rows)
    assert got == expected


def test_registry():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["station", "category", "hours", "aqi_min", "aqi_max"] and df.count() > 0
