import pytest
from pyspark.sql import functions as F

from skygauge.functions import aqi


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r[1] for r in df.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_pm25_2024_edges(spark):
    values = [0.0, 9.0, 9.05, 9.1, 35.4, 35.45, 500.0, 500.4, -0.1, None]
    expected = [0, 50, 500, 51, 100, 500, 500, 500, 500, None]
    assert column(spark, values, aqi.aqi_pm25) == expected


def test_pm25_2012_edges(spark):
    values = [12.0, 12.05, 12.1, 500.4, 501.0]
    assert column(spark, values, aqi.aqi_pm25_2012) == [50.0, 500.0, 51.0, 500.0, 500.0]


def test_pm10_edges(spark):
    values = [54.0, 54.5, 55.0, 604.0, 605.0]
    assert column(spark, values, aqi.aqi_pm10) == [50, 500, 51, 500, 500]


def test_no2_edges(spark):
    values = [0.0, 100.58, None]
    assert column(spark, values, lambda c: aqi.aqi_no2(aqi.no2_ppb(c))) == [0, 500, 0]


def test_rounds_half_to_even(spark):
    # 50/9 per unit: 0.45 -> 2.5, 0.63 -> 3.5
    assert column(spark, [2.5, 3.5], lambda c: F.rint(c)) == [2.0, 4.0]
    ladder = [round(50 / 9.0 * v) for v in (0.45, 0.63)]
    assert column(spark, [0.45, 0.63], aqi.aqi_pm25) == ladder


def test_truncate_policy_closes_the_gaps(spark):
    make = lambda c: aqi.aqi_pm25(c, "truncate")
    assert column(spark, [9.05, 35.45, 35.4, 9.0], make) == [50, 100, 100, 50]
    with pytest.raises(ValueError):
        aqi.aqi_pm25(F.lit(1.0), "other")


def test_composite_is_the_largest_and_skips_missing(spark):
    rows = [(10.0, 60.0, 10.0), (None, None, None), (None, 54.5, 1.0), (5.0, None, 188.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    parts = df.select(
        aqi.composite_aqi(F.col("a"), F.col("b"), F.col("c")).alias("all"),
        F.coalesce(aqi.aqi_pm25(F.col("a")), F.lit(0)).alias("x"),
        F.coalesce(aqi.aqi_pm10(F.col("b")), F.lit(0)).alias("y"),
        aqi.aqi_no2(aqi.no2_ppb(F.col("c"))).alias("z"),
    ).collect()
    assert [r["all"] for r in parts] == [max(r.x, r.y, r.z) for r in parts]
    assert parts[1]["all"] == 0 and parts[2]["all"] == 500


def test_categories(spark):
    assert column(spark, [50.0, 51.0, 150.0, 300.0, 301.0, None], aqi.category) == [
        "Good",
        "Moderate",
        "Unhealthy for Sensitive Groups",
        "Very Unhealthy",
        "Hazardous",
        None,
    ]
    assert column(spark, [120.0], aqi.short_category) == ["Unhealthy (Sensitive)"]
    assert column(spark, [10.0], aqi.colour) == ["#00e676"]


def test_table_form_equals_expression_form(spark):
    values = [i / 100 for i in range(-50, 60100, 7)]
    df = spark.createDataFrame([(v, "pm2_5") for v in values], "value double, pollutant string")
    joined = aqi.band_join(df)
    assert joined.filter(F.col("sub_index") != aqi.aqi_pm25(F.col("value"))).count() == 0
    assert joined.count() == len(values)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
