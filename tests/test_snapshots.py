import pytest
from pyspark.sql import functions as F

from skygauge.sources import files, snapshots

from conftest import raw_frame, to_spark
from skygauge.schemas import RAW


def numbers(spark, path, **kwargs):
    return sorted(r.x for r in snapshots.read_snapshot(spark, path, **kwargs).collect())


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def test_overwriting_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_snapshot(table(spark, 1, 2), path)
    for _ in range(3):
        old = snapshots.read_snapshot(spark, path)
        snapshots.write_snapshot(old.withColumn("x", F.col("x") * 2), path)
    assert numbers(spark, path) == [8, 16]


def test_a_job_that_fails_half_way_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_snapshot(table(spark, 1, 2), path)
    # One task writes its rows, another fails.
    bad = spark.range(0, 40, 1, 4).select(
        F.when(F.col("id") == 35, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("id").cast("int")).alias("x")
    )
    with pytest.raises(Exception, match="broken"):
        snapshots.write_snapshot(bad, path)
    assert numbers(spark, path) == [1, 2] and len(snapshots.versions(spark, path)) == 1
    # What it left goes once it is old enough, and not before.
    assert snapshots.vacuum(spark, path) == []
    left = files.names(spark, f"{path}/data")
    assert len(snapshots.vacuum(spark, path, grace_hours=-1)) == len(left) - 1
    assert numbers(spark, path) == [1, 2]


def test_old_versions_stay_for_their_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        snapshots.write_snapshot(table(spark, k), path, keep=None)
    assert [numbers(spark, path, number=k) for k in range(4)] == [[0], [1], [2], [3]]
    reader = snapshots.read_snapshot(spark, path, number=2)
    snapshots.write_snapshot(table(spark, 9), path, keep=3)
    assert [v.number for v in snapshots.versions(spark, path)] == [2, 3, 4]
    assert sorted(r.x for r in reader.collect()) == [2] and numbers(spark, path) == [9]
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path, number=0)
    with pytest.raises(ValueError):
        snapshots.vacuum(spark, path, 0)


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """Both saw version 0; each leaves a whole version, and one of them is current."""
    path = str(tmp_path / "t")
    first = snapshots.write_snapshot(table(spark, 0), path, keep=None)
    monkeypatch.setattr(snapshots, "current", lambda *args: first)
    snapshots.write_snapshot(table(spark, 1, 2), path, keep=None)
    snapshots.write_snapshot(table(spark, 3, 4), path, keep=None)
    monkeypatch.undo()
    assert numbers(spark, path) in ([1, 2], [3, 4])
    assert [v.number for v in snapshots.versions(spark, path)] == [0, 1, 1]


def test_a_version_written_again_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write_snapshot(table(spark, 1), path, keep=None, number=7)
    snapshots.write_snapshot(table(spark, 2), path, keep=None, number=7)
    assert numbers(spark, path) == [2] and [v.number for v in snapshots.versions(spark, path)] == [7]


def test_nothing_new_keeps_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.snapshot_if_any(table(spark), path) is None and snapshots.versions(spark, path) == []
    snapshots.snapshot_if_any(table(spark, 5), path)
    assert snapshots.snapshot_if_any(table(spark), path) is None and numbers(spark, path) == [5]


def test_csv_and_partitions(spark, tmp_path):
    df = to_spark(spark, raw_frame(30))
    path = str(tmp_path / "csv")
    snapshots.write_snapshot(df, path, fmt="csv")
    back = snapshots.read_snapshot(spark, path, fmt="csv", schema=RAW)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    path = str(tmp_path / "parts")
    version = snapshots.write_snapshot(df, path, partition_by="station")
    assert [n for n in files.names(spark, snapshots.folder_of(path, version)) if n[0] != "_"] == ["station=S0", "station=S1"]
