"""Positions, time buckets and overlapping chunks of station series.

Lags, rolling means and interpolation count rows, not hours, and belong to one station.
A plain ``partitionBy('station')`` window would put a whole station into one task. Here a
station is cut instead:

* ``time_bucket``: a fixed span of hours. Position = rows of all earlier buckets (a small
  aggregate) + row number inside the bucket.
* ``overlapping_chunks``: equal runs of positions, each preceded by a copy of the last
  ``halo`` rows before it, so that a window over (station, chunk) sees all it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.functions.calendar import epoch_hours
from skygauge.schemas import STATION, TIMESTAMP

BUCKET_HOURS = 512
CHUNK_ROWS = 512

BUCKET = "_bucket"
CHUNK = "_chunk"
HOME = "_home"
POS = "pos"
LENGTH = "n_rows"


def time_bucket(hours: int = BUCKET_HOURS) -> Column:
    return F.floor(epoch_hours(F.col(TIMESTAMP)) / F.lit(hours))


def in_bucket() -> Window:
    return Window.partitionBy(STATION, BUCKET).orderBy(TIMESTAMP)


def bucket_totals(summary: DataFrame) -> DataFrame:
    """Adds rows before each bucket and rows per station to (station, bucket, cnt, ..).

    One row per station and time span, so its number is bounded by the calendar.
    """
    station = Window.partitionBy(STATION)
    before = station.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn(
        "_before", F.coalesce(F.sum("cnt").over(before), F.lit(0))
    ).withColumn(LENGTH, F.sum("cnt").over(station))


def with_positions(df: DataFrame, bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Adds ``pos`` (0-based, by time within the station) and ``n_rows``."""
    bucketed = df.withColumn(BUCKET, time_bucket(bucket_hours))
    counts = bucketed.groupBy(STATION, BUCKET).agg(F.count("*").alias("cnt"))
    offsets = bucket_totals(counts).drop("cnt")
    numbered = bucketed.withColumn("_rn", F.row_number().over(in_bucket()))
    return (
        numbered.join(offsets, [STATION, BUCKET])
        .withColumn(POS, F.col("_before") + F.col("_rn") - 1)
        .drop(BUCKET, "_rn", "_before")
    )


def overlapping_chunks(df: DataFrame, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``_chunk``; rows that end a chunk are copied into the next one.

    Keep ``own_rows`` after the windows. ``df`` needs ``pos``. The explicit repartition stops
    the windows from reusing a partitioning by station alone, left over from a join.
    """
    if halo > chunk_rows:
        raise ValueError("halo must not exceed chunk_rows")
    home = F.floor(F.col(POS) / F.lit(chunk_rows))
    ends = F.col(POS) % chunk_rows >= chunk_rows - halo
    chunks = F.when(ends, F.array(HOME, F.col(HOME) + 1)).otherwise(F.array(HOME))
    chunked = df.withColumn(HOME, home).withColumn(CHUNK, F.explode(chunks))
    return chunked.repartition(STATION, CHUNK)


def in_chunk() -> Window:
    return Window.partitionBy(STATION, CHUNK).orderBy(POS)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CHUNK) == F.col(HOME)).drop(CHUNK, HOME)


def chronological_split(
    df: DataFrame, train_share: float = 0.8, bucket_hours: int = BUCKET_HOURS
) -> DataFrame:
    """Adds ``pos``, ``n_rows`` and ``is_train``: the first ``int(share * n)`` rows."""
    cut = F.floor(F.col(LENGTH) * F.lit(train_share))
    return with_positions(df, bucket_hours).withColumn("is_train", F.col(POS) < cut)


def latest_rows(df: DataFrame, by: str = TIMESTAMP) -> DataFrame:
    """The last row of every station; reduced before the shuffle."""
    last = df.groupBy(STATION).agg(F.max_by(F.struct(*df.columns), F.col(by)).alias("_row"))
    return last.select("_row.*")


def trailing_days(df: DataFrame, days: int = 7) -> DataFrame:
    """Rows within ``days`` of the station's last timestamp, bound included."""
    ends = df.groupBy(STATION).agg(F.max(TIMESTAMP).alias("_end"))
    since = F.col("_end") - F.make_dt_interval(F.lit(days))
    return df.join(ends, STATION).filter(F.col(TIMESTAMP) >= since).drop("_end")


def stride_sample(
    df: DataFrame, start: Column, stop: Column, step: int, at_most: int | None = None
) -> DataFrame:
    """Rows at positions ``start, start+step, ..`` below ``stop``; the first ``at_most``."""
    offset = F.col(POS) - start
    keep = (offset >= 0) & (F.col(POS) < stop) & (offset % step == 0)
    if at_most is not None:
        keep = keep & (offset < at_most * step)
    return df.filter(keep)


def regularize(df: DataFrame, bucket_hours: int = BUCKET_HOURS) -> DataFrame:
    """Every hour between a station's first and last row; added hours are null.

    The hours are generated per time bucket, so a long series is not one row's array.
    """
    hour = epoch_hours(F.col(TIMESTAMP))
    ends = df.groupBy(STATION).agg(F.min(hour).alias("_lo"), F.max(hour).alias("_hi"))
    first = F.floor(F.col("_lo") / bucket_hours)
    last = F.floor(F.col("_hi") / bucket_hours)
    spans = ends.withColumn("_b", F.explode(F.sequence(first, last)))
    lo = F.greatest("_lo", F.col("_b") * bucket_hours)
    hi = F.least("_hi", (F.col("_b") + 1) * bucket_hours - 1)
    hours = spans.select(STATION, F.explode(F.sequence(lo, hi)).alias("_hour"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    since = F.make_dt_interval(F.lit(0), F.col("_hour").cast("int"))
    spine = hours.select(STATION, (epoch + since).alias(TIMESTAMP))
    return spine.join(df, [STATION, TIMESTAMP], "left").select(df.columns)
