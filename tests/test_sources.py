import datetime as dt
import json
import math

from pyspark.sql import functions as F

from skygauge.functions.numeric import lenient_double
from skygauge.operators import merge
from skygauge.schemas import RAW, WEATHER
from skygauge.sources import payloads, tables

from conftest import by_key, raw_frame, to_spark

TIMES = ["2025-03-04T00:00", "2025-03-04T01:00"]


def land(root, station, name, payload):
    folder = root / f"station={station}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(payload, indent=1))


def pollutants():
    hourly = {"time": TIMES, "pm2_5": [1.5, None], "pm10": [2, 3], "nitrogen_dioxide": [4, 5]}
    hourly |= {"ozone": [6, 7], "carbon_monoxide": [8, 9], "sulphur_dioxide": [10, 11]}
    return {"latitude": 1.0, "hourly": hourly}


def test_pollutant_payloads(spark, tmp_path):
    land(tmp_path, "A", "good.json", pollutants())
    land(tmp_path, "B", "bad.json", {"error": True, "reason": "quota"})
    rows = by_key(payloads.read_pollutants(spark, str(tmp_path)))
    assert list(rows.columns) == ["station", "timestamp", "pm2_5", "pm10", "no2", "ozone", "co", "so2"]
    assert len(rows) == 2 and set(rows.station) == {"A"}
    assert rows.timestamp[1] == dt.datetime(2025, 3, 4, 1)
    assert rows.pm2_5[0] == 1.5 and math.isnan(rows.pm2_5[1])
    assert list(rows.co) == [8.0, 9.0]
    ahead = payloads.read_forecast(spark, str(tmp_path))
    assert ahead.filter("is_forecast").count() == 2


def test_weather_payloads(spark, tmp_path):
    hourly = {"time": TIMES, "temperature_2m": [20.5, 21], "relative_humidity_2m": [50, 51]}
    hourly |= {"wind_speed_10m": [1, 2], "wind_direction_10m": [10, 20], "surface_pressure": [1000, 1001]}
    land(tmp_path, "A", "w.json", {"hourly": hourly})
    rows = by_key(payloads.read_weather(spark, str(tmp_path)))
    assert rows[WEATHER].iloc[0].tolist() == [20.5, 50.0, 1.0, 10.0, 1000.0]


def reading(**changes):
    data = {
        "aqi": 57,
        "city": {"name": "Roof"},
        "time": {"s": "2025-03-04 16:00:00"},
        "iaqi": {"pm25": {"v": 57.0}, "t": {"v": 30.5}, "h": {"v": 0}, "p": {}, "dew": {"v": 12}},
    }
    data.update(changes.pop("data", {}))
    return {"status": "ok", "data": data} | changes


def test_live_payloads(spark, tmp_path):
    land(tmp_path, "ok", "1.json", reading())
    land(tmp_path, "failed", "1.json", {"status": "error", "data": "nope"})
    land(tmp_path, "noindex", "1.json", reading(data={"aqi": "-"}))
    land(tmp_path, "notime", "1.json", reading(data={"time": {"s": "yesterday"}}))
    land(tmp_path, "noiaqi", "1.json", reading(data={"iaqi": None}))
    rows = payloads.read_live(spark, str(tmp_path)).collect()
    assert [r.station for r in rows] == ["ok"]
    row = rows[0]
    assert (row.aqi_live, row.pm25_live, row.temperature, row.dew) == (57, 57.0, 30.5, 12.0)
    assert (row.humidity, row.pressure, row.wind_speed) == (0.0, 0.0, 0.0)
    assert row.station_name == "Roof" and row.timestamp == dt.datetime(2025, 3, 4, 16)


def test_csv_round_trip(spark, tmp_path):
    pdf = raw_frame(30)
    df = to_spark(spark, pdf)
    path = str(tmp_path / "raw")
    tables.write_table(df, path, fmt="csv")
    back = tables.read_csv(spark, path, RAW)
    assert back.schema == RAW
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_parquet_partitions_and_nan(spark, tmp_path):
    df = spark.createDataFrame([("A", float("nan")), ("B", 1.0)], "station string, pm2_5 double")
    path = str(tmp_path / "t")
    tables.write_table(df, path, partition_by="station")
    back = tables.read_parquet(spark, path)
    assert back.filter(F.col("pm2_5").isNull()).count() == 1


def test_station_folders(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = to_spark(spark, raw_frame(40)).repartition(7)
    tables.write_table(df, path, partition_by="station")
    assert sorted(p.name for p in (tmp_path / "raw").glob("station=*")) == ["station=S0", "station=S1"]
    assert len(list((tmp_path / "raw").glob("station=*/*.parquet"))) == 2
    back = tables.read_parquet(spark, path)
    assert back.filter("station = 'S1'").count() == 40
    assert merge.in_time_order(back).first().station == "S0"


def test_nothing_new_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "x int")
    assert tables.overwrite_if_any(df, path)
    assert not tables.overwrite_if_any(df.filter("x > 1"), path)
    assert spark.read.parquet(path).count() == 1


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "s string")
    values = [r[0] for r in df.select(lenient_double(F.col("s"))).collect()]
    assert values == [1.5, None, None, None]
