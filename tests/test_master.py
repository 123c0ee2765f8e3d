import datetime as dt
from pathlib import Path

from conftest import rows
from pyspark.sql import functions as F

from wattloom.operators.series import to_wide
from wattloom.plans.master import (
    calendar_table, dropped_readings, hourly_master, load_missing_days, meter_series, observations, write_series)
from wattloom.sources.pages import WEATHER_HEADER
from wattloom.sources.readings import read_allocations, read_readings


def test_files_to_master(spark, tmp_path):
    lines = ["1001 19501 0.14", "1001 19503 0.21", "1001 19503 0.20", "1002 19502 1.0", "1002 19549 9.0", "1003 19501 5.0",
             "1004 19549 7.0", "1001 19506 0.50"]
    for i, part in enumerate((lines[:4], lines[4:])):
        Path(tmp_path / f"r{i}.txt").write_text("\n".join(part) + "\n")
    Path(tmp_path / "alloc.csv").write_text("id,code\n1001,1\n1002,2\n1003,3\n1004,1\n")
    readings = read_readings(spark, [str(tmp_path / "r0.txt"), str(tmp_path / "r1.txt")])
    allocations = read_allocations(spark, str(tmp_path / "alloc.csv"))
    series = meter_series(readings, allocations)
    assert dropped_readings(readings).first().dropped == 2
    start = dt.datetime(2009, 7, 14)
    got = {m: [r.value for r in series.where(F.col("meter_id") == m).orderBy("pos").collect()] for m in ("1001", "1002", "1004")}
    assert series.select("meter_id").distinct().count() == 3
    # the largest code, tick 49, sets the end of the grid to the next midnight
    assert all(len(v) == 49 for v in got.values())
    assert [round(v, 6) for v in got["1001"][:7]] == [0.14, 0.17, 0.2, 0.3, 0.4, 0.5, 0.5]
    assert got["1002"] == [1.0] * 49 and got["1004"] == [None] * 49
    assert series.agg(F.min("time"), F.max("time")).first() == (start, start + dt.timedelta(days=1))

    hourly = hourly_master(series)
    first = hourly.where("meter_id = '1001'").orderBy("pos").first()
    assert (first.pos, first.time, round(first.value, 6)) == (0, start, 0.31)
    assert hourly.where("meter_id = '1004' and value <> 0").isEmpty() and hourly.count() == 3 * 25
    assert to_wide(hourly, ["1001", "1002"]).columns == ["time", "h1001", "h1002"]
    write_series(series, str(tmp_path / "series"))
    assert (tmp_path / "series" / "month=2009-07").exists() and spark.read.parquet(str(tmp_path / "series")).count() == 147

    climate = spark.createDataFrame([(start.date(), 20.5, 11.0)], "date date, temp_max double, temp_min double")
    bounds = series.agg(F.min("time").alias("start"), F.max("time").alias("end"))
    calendar = calendar_table(bounds, climate)
    assert calendar.count() == 49 and calendar.where("temp_max is null").count() == 1
    assert calendar.where("holiday_yn = 1").isEmpty() and "hour_x" in calendar.columns


def test_malformed_codes_are_dropped_alone(spark):
    lines = [("1", "19501", 1.0), ("1", "xx", 5.0), ("2", "19503", 2.0), ("2", None, 5.0), ("3", "19549", 5.0)]
    readings = spark.createDataFrame(lines, "id string, code string, value double")
    allocations = spark.createDataFrame([(i, "1") for i in "123"], "id string, code string")
    series = meter_series(readings.where("id <> '3'"), allocations)
    assert rows(series.select("meter_id", "pos", "value"), "meter_id", "pos") == [(m, i, v) for m, v in (("1", 1.0), ("2", 2.0)) for i in range(3)]
    assert dropped_readings(readings).first().dropped == 3


def page(clocks):
    head = "".join(f"<th>{n}</th>" for n in WEATHER_HEADER)
    body = "".join(
        "<tr>" + "".join(f"<td>{v}</td>" for v in (c, f"{i} F", "1 F", "50 %", "W", "3 mph", "0 mph", "29.9 in", "0.0 in", "Fair")) + "</tr>"
        for i, c in enumerate(clocks))
    return f"<table><tr>{head}</tr>{body}</table>"


def test_pages_to_observations(spark, tmp_path):
    days = [("a", dt.date(2010, 1, d), page(["11:30 PM", "12:00 AM", "6:00 AM", "11:30 PM", "12:00 AM"])) for d in (5, 6)]
    pages = spark.createDataFrame(days, "station string, date date, html string")
    got = observations(pages).where("date = date'2010-01-05'").orderBy("row").collect()
    assert [r.time for r in got] == [dt.datetime(2010, 1, 4, 23, 30), dt.datetime(2010, 1, 5), dt.datetime(2010, 1, 5, 6),
                                     dt.datetime(2010, 1, 5, 23, 30), dt.datetime(2010, 1, 6)]
    assert [r.temperature for r in got] == [0, 1, 2, 3, 4]
    path = str(tmp_path / "obs")
    load_missing_days(pages.where("date = date'2010-01-05'"), path)
    load_missing_days(pages, path)
    stored = spark.read.parquet(path)
    assert rows(stored.groupBy("date").count(), "date") == [(dt.date(2010, 1, 5), 5), (dt.date(2010, 1, 6), 5)]
