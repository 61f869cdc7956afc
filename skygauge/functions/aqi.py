"""Air-quality index: breakpoint bands, sub-indices, composite, categories.

A band maps ``lo <= v <= hi`` linearly to ``alo..ahi`` and rounds half to even. Bands are
closed and leave holes (9.0 to 9.1, say): in the default ``gap_policy='reference'`` a
value in a hole, below the first band or above the last one has index 500;
``gap_policy='truncate'`` first cuts the value to the band precision, so holes vanish.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (lo, hi, index lo, index hi) per standard and pollutant.
BREAKPOINTS: dict[tuple[str, str], list[tuple[float, float, int, int]]] = {
    ("2024", "pm2_5"): [
        (0.0, 9.0, 0, 50),
        (9.1, 35.4, 51, 100),
        (35.5, 55.4, 101, 150),
        (55.5, 125.4, 151, 200),
        (125.5, 225.4, 201, 300),
        (225.5, 500.0, 301, 500),
    ],
    ("2012", "pm2_5"): [
        (0.0, 12.0, 0, 50),
        (12.1, 35.4, 51, 100),
        (35.5, 55.4, 101, 150),
        (55.5, 150.4, 151, 200),
        (150.5, 250.4, 201, 300),
        (250.5, 500.4, 301, 500),
    ],
    ("2024", "pm10"): [
        (0.0, 54.0, 0, 50),
        (55.0, 154.0, 51, 100),
        (155.0, 254.0, 101, 150),
        (255.0, 354.0, 151, 200),
        (355.0, 424.0, 201, 300),
        (425.0, 604.0, 301, 500),
    ],
    ("2024", "no2"): [
        (0.0, 53.0, 0, 50),
        (54.0, 100.0, 51, 100),
        (101.0, 360.0, 101, 150),
        (361.0, 649.0, 151, 200),
        (650.0, 1249.0, 201, 300),
        (1250.0, 2049.0, 301, 500),
    ],
}
OUT_OF_BAND = 500
NO2_UGM3_PER_PPB = 1.88
BAND_STEPS_PER_UNIT = {"pm2_5": 10, "pm10": 1, "no2": 1}

# Upper bound (None = no bound), long label, short label, advice, colour.
CATEGORIES: list[tuple[int | None, str, str, str, str]] = [
    (50, "Good", "Good", "Air quality is excellent. Safe for all activities.", "#00e676"),
    (
        100,
        "Moderate",
        "Moderate",
        "Acceptable. Sensitive individuals take caution outdoors.",
        "#ffea00",
    ),
    (
        150,
        "Unhealthy for Sensitive Groups",
        "Unhealthy (Sensitive)",
        "Sensitive groups limit prolonged outdoor exposure.",
        "#ff9100",
    ),
    (
        200,
        "Unhealthy",
        "Unhealthy",
        "Everyone reduce outdoor activity. Wear a mask.",
        "#ff1744",
    ),
    (
        300,
        "Very Unhealthy",
        "Very Unhealthy",
        "Health alert — avoid all outdoor activity.",
        "#d500f9",
    ),
    (
        None,
        "Hazardous",
        "Hazardous",
        "Emergency — stay indoors, seal windows immediately.",
        "#b71c1c",
    ),
]

# Guideline limits shown beside the current reading, in report order.
LIMITS = [("pm2_5", 15.0), ("pm10", 45.0), ("no2", 25.0), ("so2", 40.0), ("ozone", 100.0)]


def band_index(value: Column, lo: Column, hi: Column, alo: Column, ahi: Column) -> Column:
    """Index of ``value`` inside one band; ``rint`` rounds half to even."""
    return F.rint((ahi - alo) / (hi - lo) * (value - lo) + alo)


def _banded_value(value: Column, pollutant: str, gap_policy: str) -> Column:
    value = value.cast("double")
    if gap_policy == "reference":
        return value
    if gap_policy == "truncate":
        # Via an exact decimal, so 35.4 stays in 35.4 and is not cut to 35.3.
        steps = BAND_STEPS_PER_UNIT[pollutant]
        return F.floor(F.bround(value * steps, 6)) / F.lit(float(steps))
    raise ValueError(f"unknown gap_policy {gap_policy!r}")


def sub_index(
    value: Column, pollutant: str, standard: str = "2024", gap_policy: str = "reference"
) -> Column:
    """Sub-index as double, null for a null value."""
    v = _banded_value(value, pollutant, gap_policy)
    ladder = F.when(v.isNull(), F.lit(None).cast("double"))
    for lo, hi, alo, ahi in BREAKPOINTS[standard, pollutant]:
        index = band_index(v, F.lit(lo), F.lit(hi), F.lit(float(alo)), F.lit(float(ahi)))
        ladder = ladder.when(v.between(lo, hi), index)
    return ladder.otherwise(F.lit(float(OUT_OF_BAND)))


def aqi_pm25(value: Column, gap_policy: str = "reference") -> Column:
    """PM2.5 index on the 2024 bands, int."""
    return sub_index(value, "pm2_5", gap_policy=gap_policy).cast("int")


def aqi_pm25_2012(value: Column, gap_policy: str = "reference") -> Column:
    """PM2.5 index on the 2012 bands, double; the forecast uses this one."""
    return sub_index(value, "pm2_5", standard="2012", gap_policy=gap_policy)


def aqi_pm10(value: Column, gap_policy: str = "reference") -> Column:
    return sub_index(value, "pm10", gap_policy=gap_policy).cast("int")


def no2_ppb(no2_ugm3: Column) -> Column:
    """ug/m3 to ppb; a missing reading counts as 0."""
    return F.coalesce(no2_ugm3 / F.lit(NO2_UGM3_PER_PPB), F.lit(0.0))


def aqi_no2(ppb: Column, gap_policy: str = "reference") -> Column:
    return sub_index(ppb, "no2", gap_policy=gap_policy).cast("int")


def composite_aqi(
    pm2_5: Column, pm10: Column, no2_ugm3: Column, gap_policy: str = "reference"
) -> Column:
    """Largest of the three sub-indices; a missing pollutant counts as 0."""
    return F.greatest(
        F.coalesce(aqi_pm25(pm2_5, gap_policy), F.lit(0)),
        F.coalesce(aqi_pm10(pm10, gap_policy), F.lit(0)),
        aqi_no2(no2_ppb(no2_ugm3), gap_policy),
    )


def report_aqi(pm2_5: Column, gap_policy: str = "reference") -> Column:
    """PM2.5-only index of the reports; a missing reading counts as 0."""
    return F.coalesce(aqi_pm25(pm2_5, gap_policy), F.lit(0))


def _category_field(aqi: Column, field: int) -> Column:
    bounded = [row for row in CATEGORIES if row[0] is not None]
    last = CATEGORIES[-1][field]
    head = F.when(aqi.isNull(), F.lit(None).cast("string"))
    chain = reduce(lambda acc, row: acc.when(aqi <= row[0], F.lit(row[field])), bounded, head)
    return chain.otherwise(F.lit(last))


def category(aqi: Column) -> Column:
    return _category_field(aqi, 1)


def short_category(aqi: Column) -> Column:
    return _category_field(aqi, 2)


def advice(aqi: Column) -> Column:
    return _category_field(aqi, 3)


def colour(aqi: Column) -> Column:
    return _category_field(aqi, 4)


def breakpoint_table(spark: SparkSession) -> DataFrame:
    """The bands as a table (24 literal rows)."""
    rows = [
        (standard, pollutant, lo, hi, alo, ahi)
        for (standard, pollutant), bands in BREAKPOINTS.items()
        for lo, hi, alo, ahi in bands
    ]
    schema = "standard string, pollutant string, lo double, hi double, alo int, ahi int"
    return spark.createDataFrame(rows, schema)


def band_join(df: DataFrame, standard: str = "2024") -> DataFrame:
    """Table form of the ladder over rows ``(.., pollutant, value)``.

    Adds ``lo, hi`` of the matching band (null outside every band) and ``sub_index``. The
    broadcast side is the fixed table above: a hash join on the pollutant that tests the
    six bands of that pollutant, not a nested loop.
    """
    bands = breakpoint_table(df.sparkSession).filter(F.col("standard") == standard)
    bands = F.broadcast(bands.drop("standard").withColumnRenamed("pollutant", "_pollutant"))
    inside = (F.col("pollutant") == F.col("_pollutant")) & F.col("value").between(
        F.col("lo"), F.col("hi")
    )
    index = band_index(F.col("value"), F.col("lo"), F.col("hi"), F.col("alo"), F.col("ahi"))
    return (
        df.join(bands, inside, "left")
        .withColumn(
            "sub_index",
            F.when(F.col("value").isNull(), F.lit(None).cast("int")).otherwise(
                F.coalesce(index.cast("int"), F.lit(OUT_OF_BAND))
            ),
        )
        .drop("_pollutant", "alo", "ahi")
    )
