"""Interpolation, median fill and percentile caps per station.

Order per column: interpolate, fill what is left with the median, then cap at the 1st and
99th percentile of the filled column. All three are exact, and none of them gathers a
station in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.functions.numeric import clip
from skygauge.operators.series import (
    BUCKET,
    BUCKET_HOURS,
    LENGTH,
    POS,
    bucket_totals,
    in_bucket,
    time_bucket,
)
from skygauge.schemas import MEASUREMENTS, STATION, TIMESTAMP
from skygauge.session import stage

GRID_CELLS = 64
SKETCH_ACCURACY = 200
SALTS = 16


def measured(df: DataFrame) -> list[str]:
    return [c for c in MEASUREMENTS if c in df.columns]


# -- interpolation ----------------------------------------------------------------------


def carry_forward(
    df: DataFrame, cols: list[str] | None = None, bucket_hours: int = BUCKET_HOURS
) -> DataFrame:
    """Missing values take the last one before them; adds ``pos`` and ``n_rows``.

    The causal repair: no value depends on a later row. Leading nulls stay null. The state that passes from one
    time bucket to the next is one value per column, from the same summary of buckets as in ``interpolate``.
    """
    return interpolate(df, cols, bucket_hours, causal=True)


def interpolate(
    df: DataFrame, cols: list[str] | None = None, bucket_hours: int = BUCKET_HOURS, causal: bool = False
) -> DataFrame:
    """Linear interpolation by row position; adds ``pos`` and ``n_rows``.

    Leading nulls stay null, trailing ones take the last value. The nearest values inside a
    time bucket come from windows over (station, bucket); those outside come from a summary
    of one row per bucket. Both directions use a running frame: a frame that ends at
    ``unboundedFollowing`` costs the square of its rows.
    """
    cols = measured(df) if cols is None else cols
    numbered = df.withColumn(BUCKET, time_bucket(bucket_hours)).withColumn(
        "_rn", F.row_number().over(in_bucket()).cast("long")
    )
    # Position of a known value, null for a missing one.
    at = "if({c} is null, null, _rn)"

    def each(template: str, alias: str) -> list[Column]:
        return [F.expr(template.format(c=c)).alias(alias.format(c=c)) for c in cols]

    summary = bucket_totals(
        numbered.groupBy(STATION, BUCKET).agg(
            F.count("*").alias("cnt"),
            *each(f"min({at})", "_fp_{c}"),
            *each(f"min_by({{c}}, {at})", "_fv_{c}"),
            *each(f"max({at})", "_lp_{c}"),
            *each(f"max_by({{c}}, {at})", "_lv_{c}"),
        )
    )
    outside = (
        "partition by station order by _bucket {} "
        "rows between unbounded preceding and 1 preceding"
    )
    earlier, later = outside.format("asc"), outside.format("desc")
    # Known values of other buckets as (position in the station, value).
    known = "if({x}p_{{c}} is null, null, struct({x}p_{{c}} + _before as p, {x}v_{{c}} as v))"
    carried = summary.select(
        STATION,
        BUCKET,
        "_before",
        LENGTH,
        *each(f"last({known.format(x='_l')}) ignore nulls over ({earlier})", "_in_{c}"),
        *each(f"last({known.format(x='_f')}) ignore nulls over ({later})", "_out_{c}"),
    )

    inside = (
        "partition by station, _bucket order by timestamp {} "
        "rows between unbounded preceding and current row"
    )
    so_far, from_here = inside.format("asc"), inside.format("desc")
    neighbours = numbered.select(
        "*",
        *each(f"last({at}) ignore nulls over ({so_far})", "_lp_{c}"),
        *each(f"last({{c}}) ignore nulls over ({so_far})", "_lv_{c}"),
        *each(f"last({at}) ignore nulls over ({from_here})", "_rp_{c}"),
        *each(f"last({{c}}) ignore nulls over ({from_here})", "_rv_{c}"),
    ).join(carried, [STATION, BUCKET])

    ends = neighbours.select(
        *df.columns,
        (F.col("_before") + F.col("_rn") - 1).alias(POS),
        LENGTH,
        *each("coalesce(_lp_{c} + _before, _in_{c}.p)", "_lp_{c}"),
        *each("coalesce(_lv_{c}, _in_{c}.v)", "_lv_{c}"),
        *each("coalesce(_rp_{c} + _before, _out_{c}.p)", "_rp_{c}"),
        *each("coalesce(_rv_{c}, _out_{c}.v)", "_rv_{c}"),
    )
    blend = (
        "case when {c} is not null then {c} when _rp_{c} is null then _lv_{c} "
        "else (_rv_{c} - _lv_{c}) / (_rp_{c} - _lp_{c}) * (pos + 1 - _lp_{c}) + _lv_{c} end"
    )
    if causal:
        # What looks ahead is not read then, and the optimizer leaves it out.
        blend = "coalesce({c}, _lv_{c})"
    blended = dict(zip(cols, each(blend, "{c}")))
    return ends.select(*[blended.get(c, F.col(c)) for c in df.columns], POS, LENGTH)


# -- exact quantiles --------------------------------------------------------------------
#
# Sorted values v[0..n-1] of a column, plus missing rows that the median will fill. The
# filled column, sorted, is v[0..a-1], the medians, v[a..n-1] with a = ceil(n / 2), so its
# percentiles follow from values of v at known ranks and one pass serves all three.


def _target(name: str, share: float, total: str) -> str:
    """Struct of the ranks in v on both sides of a percentile, and the weight between.

    A null rank stands for the median itself.
    """
    at = f"(({total} - 1) * {share}D)"
    low = f"floor({at})"
    high = f"least(floor({at}) + 1, {total} - 1)"
    middle = "floor((n + 1) / 2)"

    def rank(j: str) -> str:
        return (
            f"case when {j} < {middle} then {j} "
            f"when {j} >= {middle} + {total} - n then {j} - {total} + n end"
        )

    return (
        f"struct('{name}' as target, {rank(low)} as r0, {rank(high)} as r1, "
        f"{at} - floor({at}) as weight)"
    )


def station_quantiles(
    df: DataFrame, cols: list[str], lower: float = 0.01, upper: float = 0.99
) -> DataFrame:
    """(station, measure, median, lower, upper), exact, with linear interpolation.

    ``lower`` and ``upper`` are those of the column after its median fill.

    1. A mergeable sketch per station and column gives a grid of approximate quantiles.
       Its error (1/200 of the rows) is far below a grid cell (1/64), so the cells around
       a rank are sure to enclose its value.
    2. Values below the enclosing cells are counted, values inside are counted one by one:
       both in one aggregate with a partial step.
    3. The ranks are looked up in the running counts of the few values inside.

    Only step 3 gathers rows: the distinct values of three cells or so, about a twentieth
    of one column of one station.
    """
    grid = F.array(*[F.lit(i / GRID_CELLS) for i in range(GRID_CELLS + 1)])
    sketches = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.count(c).alias("n"),
                F.percentile_approx(c, grid, F.lit(SKETCH_ACCURACY)).alias("grid"),
            )
            for i, c in enumerate(cols)
        ]
    )
    sketch = (
        df.groupBy(STATION)
        .agg(F.count("*").alias("total"), sketches.alias("sketches"))
        .select(STATION, "total", F.inline("sketches"))
    )
    wanted = ", ".join(
        [
            _target("median", 0.5, "n"),
            _target("lower", lower, "total"),
            _target("upper", upper, "total"),
        ]
    )
    first_cell = f"floor(least(r0, r1) * {GRID_CELLS} / n) - 1"
    last_cell = f"floor(greatest(r0, r1) * {GRID_CELLS} / n) + 2"
    ranks = sketch.filter("n > 0").select("*", F.expr(f"inline(array({wanted}))"))
    target = ["i", "target", "r0", "r1", "weight"]
    # Past either end of the grid ``get`` finds nothing: there is no bound then.
    bounded = ranks.select(
        STATION,
        *target,
        F.expr(f"coalesce(get(grid, cast({first_cell} as int)), double('-inf'))").alias("lo"),
        F.expr(f"coalesce(get(grid, cast({last_cell} as int)), double('inf'))").alias("hi"),
    )
    # One row per station, three targets per column. Salted, so that a station too large for
    # one task is joined in SALTS parts, and the aggregate after it cannot inherit a
    # partitioning that puts the station back together.
    targets = bounded.groupBy(STATION).agg(
        F.collect_list(F.struct(*target, "lo", "hi")).alias("targets")
    )
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(TIMESTAMP), F.lit(SALTS)).alias("salt")
    counted = (
        df.select(STATION, salt, F.array(*cols).alias("row"))
        .join(salted, [STATION, "salt"])
        .select(STATION, "row", F.inline("targets"))
        .withColumn("value", F.get("row", F.col("i")))
        .filter("value <= hi")
        .withColumn("inside", F.expr("if(value >= lo, value, null)"))
        .groupBy(STATION, *target, "inside")
        .agg(F.count("*").alias("copies"))
    )
    running = (
        Window.partitionBy(STATION, *target)
        .orderBy(F.asc_nulls_first("inside"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        counted.withColumn("upto", F.sum("copies").over(running))
        .groupBy(STATION, *target)
        .agg(
            F.expr("min(if(upto > r0, inside, null))").alias("x0"),
            F.expr("min(if(upto > r1, inside, null))").alias("x1"),
            F.expr("coalesce(max(if(inside is null, upto, null)), 0)").alias("below"),
        )
    )
    lost = "least(r0, r1) < below or (r0 is not null and x0 is null) or (r1 is not null and x1 is null)"
    checked = found.withColumn(
        "x0", F.expr(f"if({lost}, raise_error('quantile cell misses its rank'), x0)")
    )
    per_measure = checked.groupBy(STATION, "i").agg(
        *[
            F.expr(f"max(if(target = '{t}', {x}, null))").alias(f"{t}_{x}")
            for t in ("median", "lower", "upper")
            for x in ("x0", "x1", "weight")
        ]
    )
    median = "median_x0 + (median_x1 - median_x0) * median_weight"

    def between(t: str) -> Column:
        a, b = f"coalesce({t}_x0, median)", f"coalesce({t}_x1, median)"
        return F.expr(f"{a} + ({b} - {a}) * {t}_weight").alias(t)

    measure = F.get(F.array(*[F.lit(c) for c in cols]), F.col("i")).alias("measure")
    return per_measure.withColumn("median", F.expr(median)).select(
        STATION, measure, "median", between("lower"), between("upper")
    )


# -- fill and cap -----------------------------------------------------------------------


def _with_quantiles(df: DataFrame, quantiles: DataFrame, cols: list[str]) -> DataFrame:
    """Adds the quantiles of every column as ``_{c}_median`` and so on."""
    names = [(c, q) for c in cols for q in ("median", "lower", "upper")]
    wide = quantiles.groupBy(STATION).agg(
        *[F.expr(f"max(if(measure = '{c}', {q}, null)) as _{c}_{q}") for c, q in names]
    )
    return df.join(wide, STATION, "left")


def median_fill(df: DataFrame, quantiles: DataFrame, cols: list[str]) -> DataFrame:
    filled = {c: F.expr(f"coalesce({c}, _{c}_median) as {c}") for c in cols}
    joined = _with_quantiles(df, quantiles, cols)
    return joined.select([filled.get(c, F.col(c)) for c in df.columns])


def fill_and_clip(df: DataFrame, quantiles: DataFrame, cols: list[str]) -> DataFrame:
    def repaired(c: str) -> Column:
        filled = F.expr(f"coalesce({c}, _{c}_median)")
        return clip(filled, F.col(f"_{c}_lower"), F.col(f"_{c}_upper")).alias(c)

    joined = _with_quantiles(df, quantiles, cols)
    return joined.select([repaired(c) if c in cols else F.col(c) for c in df.columns])


def repair(
    df: DataFrame, bucket_hours: int = BUCKET_HOURS, train_share: float | None = None
) -> DataFrame:
    """Interpolate, fill and cap every measurement present; adds ``pos`` and ``n_rows``.

    ``df`` is read twice, so it should be a saved table rather than a long plan. The
    interpolated series is read three times and is staged here. ``train_share`` fits
    medians and caps on the first part of each station only.
    """
    cols = measured(df)
    series = stage(interpolate(df, cols, bucket_hours), "series")
    fit_on = series
    if train_share is not None:
        fit_on = series.filter(F.col(POS) < F.floor(F.col(LENGTH) * F.lit(train_share)))
    return fill_and_clip(series, station_quantiles(fit_on, cols), cols)
