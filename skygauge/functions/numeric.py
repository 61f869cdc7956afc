"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def lenient_double(value: Column) -> Column:
    """Number or null, never an error; NaN is null as well."""
    return nan_to_null(value.try_cast("double"))


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def clip(value: Column, lo: Column, hi: Column) -> Column:
    """Null stays null (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, lo), hi))


def non_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def positive_or_one(value: Column) -> Column:
    return F.when(value > 0, value).otherwise(F.lit(1.0))


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def round_binary(value: Column, places: int) -> Column:
    """A double rounded by its exact binary value: 2.675 is a little less than that, so it gives 2.67 to 2 places.

    Its exact decimal expansion decides, which ``bround`` (of the shortest one) does not see. The double nearest to
    the rounded value is within half a step of the exact value; both neighbours are compared with it in
    exact arithmetic: v * 10^places is a double product p and its error e, both exact by splitting (no
    fused operation needed), so p + e tells on which side of a half v lies. Ties go to even. Values of
    2^51 / 10^places and more have no such digits and stay as they are; null, NaN and infinity stay.
    """
    if not 0 <= places <= 15:
        raise ValueError("0 to 15 places")
    scale = F.lit(float(10**places))
    p = value * scale
    # Dekker's product: each factor as a sum of two halves of its digits.
    high = lambda x: x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    a, b = high(value), high(scale)
    rest_a, rest_b = value - a, scale - b
    error = rest_a * rest_b - (((p - a * b) - rest_a * b) - a * rest_b)
    below = F.floor(p).cast("double")
    over_half = (p - below - F.lit(0.5)) + error
    # An error may pull p below a whole number that it rounds to.
    odd = below % 2 != 0
    up = F.when(over_half > 0, 1.0).when((over_half == 0) & odd, 1.0).otherwise(0.0)
    rounded = (below + up) / scale
    plain = F.abs(value) < F.lit(2.0**51) / scale
    return F.when(plain, rounded).otherwise(value)


def truncated_int(value: Column) -> Column:
    return value.cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / (denominator + F.lit(EPSILON))


def interaction_parts(
    pm2_5: Column, pm10: Column, wind_speed: Column, temperature: Column, humidity: Column
) -> dict[str, Column]:
    return {
        "pm_ratio": ratio(pm2_5, pm10),
        "wind_dispersion": ratio(wind_speed, pm2_5),
        "heat_humidity": temperature * humidity / F.lit(100),
    }
