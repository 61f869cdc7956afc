import datetime as dt
import json

import pytest

from skygauge.session import is_local, release, scratch_path, stage
from skygauge.sources import payloads
from skygauge.streaming import live


def land(folder, i, station, minute, value):
    time = dt.datetime(2025, 3, 4, 10) + dt.timedelta(minutes=minute)
    data = {
        "aqi": 50,
        "city": {"name": "Roof"},
        "time": {"s": str(time)},
        "iaqi": {"pm25": {"v": value}},
    }
    target = folder / f"station={station}"
    target.mkdir(parents=True, exist_ok=True)
    (target / f"{i:03d}.json").write_text(json.dumps({"status": "ok", "data": data}))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("max_files", [1, 1000])
def test_stream_equals_batch_whatever_the_order(spark, tmp_path, max_files):
    i = 0
    for station in ("A", "B"):  # B's backlog lands after all of A
        for minute in range(0, 240, 60):
            for _ in range(2):  # delivered twice
                land(tmp_path, i, station, minute, 10.0 + minute % 7)
                i += 1
    readings = live.live_values(payloads.stream_live(spark, str(tmp_path), max_files=max_files))
    streamed = live.drain(readings)
    batch = live.hourly_live(live.live_values(payloads.read_live(spark, str(tmp_path))))
    assert rows(streamed) == rows(batch)
    assert streamed.count() == 8 and {r.readings for r in streamed.collect()} == {1}


def test_redelivery_in_a_later_run_counts_once(spark, tmp_path):
    landing = tmp_path / "landing"
    store, state = scratch_path(spark, "live"), scratch_path(spark, "state")
    for i, minute in enumerate((0, 20, 70)):
        land(landing, i, "A", minute, 5.0)
    source = lambda: live.live_values(payloads.stream_live(spark, str(landing)))
    first = rows(live.drain(source(), store, state))
    land(landing, 9, "A", 20, 5.0)
    assert rows(live.drain(source(), store, state)) == first
    land(landing, 10, "A", 40, 5.0)
    assert sorted(r.readings for r in live.drain(source(), store, state).collect()) == [1, 3]


def test_a_second_drain_reads_new_files_only(spark, tmp_path):
    landing = tmp_path / "landing"
    store, state = scratch_path(spark, "live"), scratch_path(spark, "state")
    seen = []

    def drained():
        query = live.start(live.live_values(payloads.stream_live(spark, str(landing))), store, state)
        query.awaitTermination()
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
        return rows(live.stored_hours(spark, store))

    for i in range(6):
        land(landing, i, "A", 20 * i, 5.0 + i)
    drained()
    land(landing, 6, "A", 20, 4.0)  # a smaller copy of a reading replaces it
    land(landing, 7, "B", 300, 9.0)
    land(landing, 8, "A", 10, 2.0)  # late, into an hour that is there
    found = drained()
    assert seen == [6, 3]
    assert found == rows(live.hourly_live(live.live_values(payloads.read_live(spark, str(landing)))))


def test_folding_and_retried_batches_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "FOLD_AFTER", 2)
    landing = tmp_path / "landing"
    store, state = scratch_path(spark, "live"), scratch_path(spark, "state")
    folds, fold = [], live.fold
    monkeypatch.setattr(live, "fold", lambda spark, path: folds.append(path) or fold(spark, path))
    for i in range(9):
        land(landing, i, "AB"[i % 2], 25 * (i % 6), float(i))
    batch = lambda: rows(live.hourly_live(live.live_values(payloads.read_live(spark, str(landing)))))
    found = live.drain(live.live_values(payloads.stream_live(spark, str(landing), max_files=1)), store, state)
    assert rows(found) == batch() and len(folds) >= 2
    # The last batch is stored again, as after a driver that died before noting it.
    number = max(live._numbers(live.files.names(spark, f"{store}/readings/batches")))
    live._store(live.live_values(payloads.read_live(spark, str(landing))).limit(1), store, number)
    live._store(live.live_values(payloads.read_live(spark, str(landing))), store, number)
    assert rows(live.stored_hours(spark, store)) == batch()
    live.fold(spark, store)
    assert rows(live.stored_hours(spark, store)) == batch()


def test_nothing_landed_yet(spark):
    assert live.stored_hours(spark, scratch_path(spark, "nothing")).isEmpty()


def test_missing_values_and_sensors(spark, tmp_path):
    """As in one go: a missing value is the smallest copy, counts as a reading and adds nothing."""
    at = dt.datetime(2025, 3, 4, 10)
    data = [("A", at, 100, 1, 1), ("A", at, None, 1, 1), ("A", at, 300, 1, 2), ("B", at, None, 1, 1), ("A", at, 40, 1, None)]
    df = spark.createDataFrame(data, "station string, timestamp timestamp_ntz, value long, weight int, sensor int")
    folder = str(tmp_path / "r")
    df.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    assert rows(live.drain(stream)) == rows(live.hourly_live(df))


def test_sensors_at_one_time_are_told_apart(spark):
    at = dt.datetime(2025, 3, 4, 10)
    df = spark.createDataFrame(
        [("A", at, 100, 1, 1), ("A", at, 300, 1, 2), ("A", at, 300, 1, 2)],
        "station string, timestamp timestamp_ntz, value long, weight int, sensor int",
    )
    (row,) = live.hourly_live(df).collect()
    assert (row.readings, row.pm2_5) == (2, 200.0)


def test_staged_folders_are_released(spark):
    assert is_local("local[8]") and is_local("local") and not is_local("local-cluster[2,1,1024]")
    staged = stage(spark.range(3), "gone")
    assert staged.count() == 3
    path = staged.inputFiles()[0]
    release(spark)
    with pytest.raises(Exception, match="(?i)does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(path)
