"""Rounding by the exact binary value, against Python's own."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skygauge.functions.numeric import round_binary


def rounded(spark, values, places):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    return [
        r.r for r in sorted(df.select("k", round_binary(F.col("v"), places).alias("r")).collect(), key=lambda r: r.k)
    ]


@pytest.mark.parametrize("places", [0, 1, 2, 3, 6])
def test_equals_python(spark, places):
    ties = [k / 10**d + s for d in range(1, 8) for k in range(-205, 206, 5) for s in (0.0, 1e-9, -1e-9, 2.0)]
    odd = [2.675, 1.005, 0.125, 2.5, 3.5, -2.675, -0.5, 1e15 + 0.5, 1e300, 5e-324, 0.0, 123456.785, 0.615, 1.115, 0.5 - 2**-54, 1 - 2**-53]
    values = ties + odd
    for v, got in zip(values, rounded(spark, values, places), strict=True):
        assert got == round(v, places), v


def test_missing_and_infinite(spark):
    null, nan, inf = rounded(spark, [None, float("nan"), float("inf")], 2)
    assert null is None and math.isnan(nan) and inf == float("inf")
    with pytest.raises(ValueError):
        round_binary(F.lit(1.0), 20)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9), min_size=50, max_size=200), st.sampled_from([0, 2, 3]))
def test_equals_python_on_any_numbers(spark, values, places):
    for v, got in zip(values, rounded(spark, values, places), strict=True):
        assert got == round(v, places)
