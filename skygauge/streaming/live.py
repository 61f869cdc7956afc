"""Live readings as a stream: deduplicated hourly index per station.

A reading counts once however often and late it is delivered. Readings are told apart by station, time and, if there,
``sensor``; of copies that differ, the smallest stays. ``value`` and ``weight`` are summed and divided, so
integer values give a mean that does not depend on the order of arrival.

The stream keeps its own state as a table: the reading that stands for each (station, sensor, time), stored batch by batch
and sorted by day. A batch is compared with the stored readings of its own days alone. A new reading, or one that
replaces a larger copy, changes its hour's sums by a difference, and the differences are stored as well. Each batch has a folder
of its own that a retried batch overwrites, and sees those of earlier batches only, so each counts once.
Now and then the folders are folded into snapshots that carry the last batch's number. So a drain reads new files only, and
the hours are sums over one row per hour and the differences since the last snapshot. All of it stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skygauge.functions.aqi import category, report_aqi
from skygauge.functions.calendar import hour_start
from skygauge.schemas import STATION, TIMESTAMP
from skygauge.session import scratch_path, stage
from skygauge.sources import files, snapshots

SENSOR = "sensor"
HOUR = "hour"
DAY = "day"
# Folders of differences after which they are folded.
FOLD_AFTER = 20
SUMS = ["value", "weight", "known", "readings"]


def _hours(sums: DataFrame) -> DataFrame:
    """(station, hour, value, weight, known, readings) to the hourly table."""
    value = F.when(F.col("known") > 0, F.col("value"))
    mean = F.try_divide(value.cast("double"), F.col("weight").cast("double"))
    rows = sums.select(STATION, F.col(HOUR).alias(TIMESTAMP), "readings", mean.alias("pm2_5"))
    with_index = rows.withColumn("aqi", report_aqi(F.col("pm2_5")))
    return with_index.withColumn("category", category(F.col("aqi")))


def hourly_live(readings: DataFrame) -> DataFrame:
    """Landed readings ``(station, timestamp, value, weight)`` to one row per station and hour, in one go."""
    key = [STATION, TIMESTAMP, *(c for c in [SENSOR] if c in readings.columns)]
    once = readings.groupBy(*key).agg(F.min(F.struct("value", "weight")).alias("_first")).select(*key, "_first.*")
    hours = once.groupBy(STATION, hour_start(F.col(TIMESTAMP)).alias(HOUR)).agg(
        F.sum("value").alias("value"), F.sum("weight").alias("weight"),
        F.count("value").alias("known"), F.count("*").alias("readings"),
    )
    return _hours(hours)


def live_values(live: DataFrame) -> DataFrame:
    """Input of ``hourly_live`` from live readings."""
    return live.select(
        STATION, TIMESTAMP, F.col("pm25_live").alias("value"), F.lit(1).alias("weight")
    )


# -- stream -----------------------------------------------------------------------------


def _keyed(readings: DataFrame) -> DataFrame:
    """Readings with their key and, as one ordered value, what they say; a missing value comes before all others."""
    sensor = F.col(SENSOR).cast("string") if SENSOR in readings.columns else F.lit("")
    said = F.struct(F.col("value").isNotNull().alias("known"), F.coalesce(F.col("value"), F.lit(0)).alias("value"), F.coalesce(F.col("weight"), F.lit(0)).cast("long").alias("weight"))
    return readings.select(
        STATION, TIMESTAMP, F.coalesce(sensor, F.lit("\0")).alias(SENSOR), F.to_date(TIMESTAMP).alias(DAY), said.alias("said")
    )


def _batch(number: int) -> str:
    return f"batch={number:012d}"


def _numbers(names: list[str]) -> list[int]:
    return [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]


def _stored(spark: SparkSession, path: str, before: int | None = None) -> list[DataFrame]:
    """The last snapshot of a table, and its folders of later batches; those ``before`` a batch if asked for."""
    folded = snapshots.current(spark, f"{path}/folded")
    first = -1 if folded is None else folded.number
    numbers = [n for n in _numbers(files.names(spark, f"{path}/batches")) if n > first and (before is None or n < before)]
    frames = [] if folded is None else [spark.read.parquet(snapshots.folder_of(f"{path}/folded", folded))]
    if numbers:
        frames.append(spark.read.parquet(*[f"{path}/batches/{_batch(n)}" for n in sorted(numbers)]))
    return frames


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(STATION, HOUR).agg(*[F.sum(c).alias(c) for c in SUMS])


def _readings(rows: DataFrame) -> DataFrame:
    """The smallest copy of each reading."""
    return rows.groupBy(STATION, TIMESTAMP, SENSOR, DAY).agg(F.min("said").alias("said"))


def _changed(batch: DataFrame, path: str, number: int) -> DataFrame:
    """Readings of a batch that are new or replace a larger copy, with what was stored (``old``)."""
    new = _readings(_keyed(batch))
    earlier = _stored(batch.sparkSession, f"{path}/readings", number)
    if not earlier:
        return new.withColumn("old", F.lit(None).cast(new.schema["said"].dataType))
    # As many as the batch has days; they reach the scan, and files are sorted by day.
    days = [r[DAY] for r in new.select(DAY).distinct().collect()]
    old = _readings(reduce(DataFrame.unionByName, earlier).filter(F.col(DAY).isin(days)))
    found = new.join(old.withColumnRenamed("said", "old"), [STATION, TIMESTAMP, SENSOR, DAY], "left")
    return found.filter("old is null or said < old")


def _store(batch: DataFrame, path: str, number: int) -> None:
    batch = batch.persist()
    spark = batch.sparkSession
    changed = stage(_changed(batch, path, number), "changed")
    was = lambda c: F.coalesce(F.col(f"old.{c}"), F.lit(0))
    known = lambda c: F.coalesce(F.col(f"{c}.known").cast("long"), F.lit(0))
    differences = changed.select(
        STATION, hour_start(F.col(TIMESTAMP)).alias(HOUR),
        (F.col("said.value") - was("value")).alias("value"), (F.col("said.weight") - was("weight")).alias("weight"),
        (known("said") - known("old")).alias("known"), F.col("old").isNull().cast("long").alias("readings"),
    )
    _sums(differences).write.mode("overwrite").parquet(f"{path}/hours/batches/{_batch(number)}")
    # Last, as earlier batches alone are looked at: a batch that ends before this is done again from the same state.
    kept = changed.drop("old").sortWithinPartitions(DAY)
    kept.write.mode("overwrite").parquet(f"{path}/readings/batches/{_batch(number)}")
    batch.unpersist()
    if len(files.names(spark, f"{path}/hours/batches")) > FOLD_AFTER:
        fold(spark, path)


def start(readings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store what landed readings change, exactly once; drains what is there.

    Nothing is left out by its time of arrival, so neither the order of files nor their number per batch matters.
    """
    return (
        readings.writeStream.foreachBatch(lambda batch, number: _store(batch, path, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold(spark: SparkSession, path: str) -> None:
    """Fold all batches but the last into snapshots numbered like the last one in them, and drop their folders.

    The last batch stays out: it may be run again before the stream notes that it is done.
    """
    numbers = sorted(_numbers(files.names(spark, f"{path}/readings/batches")))
    if len(numbers) < 2:
        return
    for table, fold_rows in (("hours", _sums), ("readings", lambda df: _readings(df).sortWithinPartitions(DAY))):
        earlier = _stored(spark, f"{path}/{table}", numbers[-1])
        snapshots.write_snapshot(fold_rows(reduce(DataFrame.unionByName, earlier)), f"{path}/{table}/folded", number=numbers[-2])
        for number in numbers[:-1]:
            files.delete(spark, f"{path}/{table}/batches/{_batch(number)}")


def stored_hours(spark: SparkSession, path: str) -> DataFrame:
    """The hourly table as stored so far."""
    stored = _stored(spark, f"{path}/hours")
    if not stored:
        kinds = "value double, weight long, known long, readings long"
        stored = [spark.createDataFrame([], f"{STATION} string, {HOUR} timestamp_ntz, {kinds}")]
    return _hours(_sums(reduce(DataFrame.unionByName, stored)))


def drain(readings: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over all files landed since the last drain and give the hours of all readings.

    ``path`` and ``checkpoint`` belong together: they hold what earlier drains have seen.
    """
    spark = readings.sparkSession
    path = path or scratch_path(spark, "live")
    start(readings, path, checkpoint or scratch_path(spark, "live-state")).awaitTermination()
    return stored_hours(spark, path)
