import datetime as dt
import math

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattloom.conf import ForecastConf
from wattloom.functions.calendar import (
    HOLIDAYS, calendar_features, days_in_month, features_for, holiday_flag, holiday_table, time_features, weekday_flags)
from wattloom.functions.columns import column_positions, columns_like, drop_like, use_columns
from wattloom.functions.text import obs_time, strip_unit, url_base, url_date
from wattloom.functions.timecode import code_grid, decode_code, encode_code, floor_time, from_epoch_seconds, off_grid, step_index


def times(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t timestamp_ntz")


def test_codes(spark):
    codes = spark.createDataFrame([("19502",), ("00748",), ("00149",), ("abc",)], "c string")
    got = codes.select(decode_code(F.col("c")).alias("t"), off_grid(F.col("c")).alias("o")).collect()
    assert got[0].t == dt.datetime(2009, 7, 14, 0, 30) and not got[0].o
    assert got[1].t == dt.datetime(2009, 1, 7, 23, 30)
    assert got[2].t == dt.datetime(2009, 1, 2) and got[2].o
    assert got[3].t is None
    day7 = times(spark, dt.datetime(2009, 1, 7), dt.datetime(2012, 1, 1)).select(encode_code(F.col("t")).alias("c"))
    assert [r.c for r in day7.collect()] == ["00701", None]


def test_code_roundtrip_over_the_whole_calendar(spark):
    bounds = times(spark, dt.datetime(2009, 1, 1)).select("t", F.lit(dt.datetime(2011, 9, 26, 23, 30)).cast("timestamp_ntz").alias("z"))
    grid = code_grid(bounds, "t", "z")
    back = grid.withColumn("again", decode_code(F.col("code")))
    assert grid.count() == 999 * 48 and grid.select("code").distinct().count() == 999 * 48
    assert back.where("again <> time or again is null").isEmpty()


def test_times_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        at = dt.datetime(2009, 3, 8, 2, 30, 15)  # a local time that does not exist there
        got = times(spark, at).select(
            floor_time(F.col("t"), 1800).alias("half"), floor_time(F.col("t")).alias("hour"), floor_time(F.col("t"), 86400).alias("day"),
            from_epoch_seconds(F.lit(0)).alias("zero"), step_index(F.col("t"), 900).alias("n")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got.half == dt.datetime(2009, 3, 8, 2, 30) and got.hour == dt.datetime(2009, 3, 8, 2) and got.day == dt.datetime(2009, 3, 8)
    assert got.zero == dt.datetime(1970, 1, 1)
    assert got.n == int((at - dt.datetime(1970, 1, 1)).total_seconds()) // 900


@settings(max_examples=10, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1960, 1, 1), dt.datetime(2050, 1, 1)), min_size=1, max_size=20), st.sampled_from([60, 900, 1800, 3600, 7200, 86400]))
def test_floor_time_matches_arithmetic(spark, values, step):
    got = times(spark, *values).select("t", floor_time(F.col("t"), step).alias("f")).collect()
    origin = dt.datetime(1970, 1, 1)
    for r in got:
        whole = int((r.t - origin) // dt.timedelta(seconds=step))
        assert r.f == origin + dt.timedelta(seconds=whole * step)


def test_calendar_row(spark):
    at = dt.datetime(2009, 2, 14, 6, 30)
    got = calendar_features(times(spark, at).withColumnRenamed("t", "time")).first()
    assert got.date == at.date()
    assert got.hour_x == pytest.approx(math.sin(2 * math.pi * 6.5 / 24)) and got.minute_y == pytest.approx(math.cos(math.pi))
    assert got.day_x == pytest.approx(math.sin(math.pi)) and got.month_y == pytest.approx(math.cos(2 * math.pi * 2 / 12))
    assert got.sat_yn == 1 and got.mon_yn == 0
    sunday = times(spark, dt.datetime(2009, 2, 15)).select(*weekday_flags(F.col("t")).values()).first()
    assert sum(sunday) == 0
    feb = times(spark, dt.datetime(2012, 2, 3), dt.datetime(2011, 2, 3)).select(days_in_month(F.col("t")).alias("n"))
    assert [r.n for r in feb.collect()] == [29, 28]


def test_holidays(spark):
    assert len(HOLIDAYS) == 39 and all(sum(h.startswith(str(y)) for h in HOLIDAYS) == 13 for y in (2009, 2010, 2011))
    days = spark.createDataFrame([(dt.date(2010, 4, 2),), (dt.date(2010, 4, 3),)], "date date")
    assert rows(holiday_flag(days, holiday_table(spark)), "date") == [(dt.date(2010, 4, 2), 1), (dt.date(2010, 4, 3), 0)]


def test_frequencies(spark):
    assert features_for("12H") == ("hour", "weekday", "day", "dayofyear") == features_for("h")
    assert features_for("5min") == features_for("T") and features_for("W-SUN") == ("day", "week")
    assert features_for("A") == () and features_for("QE") == ("month",) and len(features_for("S")) == 6
    with pytest.raises(ValueError):
        features_for("fortnight")
    got = times(spark, dt.datetime(2010, 12, 31, 23, 59, 59)).select(*[c.alias(n) for n, c in time_features(F.col("t"), "S").items()]).first()
    assert got.second == got.minute == got.hour == got.day == 0.5 and got.dayofyear == pytest.approx(364 / 365 - 0.5)


def test_weather_text(spark):
    df = spark.createDataFrame(
        [("45 F ", "12:05 AM", "2010-03-04"), ("--", "1:30 pm", "2010-11-30"), ("7F", "noon", "2010-01-01")], "v string, c string, d string")
    got = df.select(strip_unit(F.col("v"), "F").alias("v"), obs_time(F.col("d"), F.col("c")).alias("t"), url_date(F.col("d")).alias("u")).collect()
    assert [r.v for r in got] == [45.0, None, 7.0]
    assert [r.t for r in got] == [dt.datetime(2010, 3, 4, 0, 5), dt.datetime(2010, 11, 30, 13, 30), None]
    assert [r.u for r in got] == ["2010-3-4", "2010-11-30", "2010-1-1"]
    urls = spark.createDataFrame([("https://w.example/history/daily/ie/a/date/2020-3-14",), ("https://w.example/other/x",)], "u string")
    assert [r.b for r in urls.select(url_base(F.col("u")).alias("b")).collect()] == [
        "https://w.example/history/daily/ie/a/date", "https://w.example/other/x"]


def test_column_families(spark):
    wide = spark.createDataFrame([(1,) * 6], "time int, temp_max_d1_t_ int, minute_x int, h10 int, h2 int, temp_d9_t_ int")
    assert columns_like(wide, "^h[0-9]+") == ["h10", "h2"]
    assert drop_like(wide, "^minute_").columns == ["time", "temp_max_d1_t_", "h10", "h2", "temp_d9_t_"]
    assert use_columns(wide) == ["temp_max_d1_t_", "h10", "h2"] and column_positions(wide, use_columns(wide)) == [1, 3, 4]
    assert use_columns(wide, ForecastConf(time_var_format="h1.*")) == ["h10", "h2"]


def test_conf_is_checked_and_frozen():
    with pytest.raises(ValueError):
        ForecastConf(season="spring")
    with pytest.raises(AttributeError):
        ForecastConf().season = "winter"
