import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wattloom.functions.timecode import off_grid
from wattloom.operators.climate import clean_observations, day_rollover, major_group
from wattloom.operators.joins import beside, hot_join, join_climate, keep_allocated, salted_join
from wattloom.operators.ordered import even_block, number_block, positions
from wattloom.operators.series import (
    cluster_totals, code_range, day_lags, decompose, distinct_ids, fill_gaps, first_per_key, moving_average, regular_series,
    sample_meters, seasonal_lags, single_cluster, skip_steps, to_daily, to_hourly, to_long, to_steps, to_wide)


def series_of(spark, values, key=0):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "meter_id int, step long, value double")


def filled(spark, values, lo=0, hi=None):
    hi = len(values) - 1 if hi is None else hi
    got = fill_gaps(series_of(spark, values), "meter_id", "step", "value", F.lit(lo).cast("long"), F.lit(hi).cast("long"))
    return [r.value for r in got.orderBy("step").collect()]


def test_gap_filling(spark):
    assert filled(spark, [None, 1, None, 3, None, None]) == [1, 1, 2, 3, 3, 3]
    assert filled(spark, [None, None, None]) == [None, None, None]
    assert filled(spark, [5], 0, 3) == [5, 5, 5, 5]


def test_gap_filling_matches_pandas(spark):
    rng = np.random.default_rng(1)
    frames = []
    for meter in range(6):
        v = pd.Series(rng.normal(size=200)).where(rng.random(200) < 0.2)
        frames.append(pd.DataFrame({"meter_id": meter, "step": range(200), "value": v}))
    whole = pd.concat(frames)
    sparse = spark.createDataFrame(whole.dropna())
    got = fill_gaps(sparse, "meter_id", "step", "value", F.lit(0).cast("long"), F.lit(199).cast("long")).toPandas()
    for meter, frame in enumerate(frames):
        want = frame["value"].interpolate().bfill().to_numpy()
        mine = got[got.meter_id == meter].sort_values("step")["value"].to_numpy()
        np.testing.assert_allclose(mine, want, rtol=1e-12)


def test_regular_series_has_one_sort_and_no_python(spark):
    at = dt.datetime(2010, 1, 1)
    data = [(1, at, 1.0), (1, at + dt.timedelta(minutes=20), 2.0), (1, at + dt.timedelta(hours=2), 5.0), (2, at + dt.timedelta(hours=3), 7.0)]
    readings = spark.createDataFrame(data, "meter_id int, time timestamp_ntz, value double")
    df = regular_series(readings)
    assert [r.value for r in df.orderBy("meter_id", "pos").collect()] == [3, 4, 5, 5, 7, 7, 7, 7]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Sort [") == 1 and "Python" not in plan and "Join" not in plan


def test_roll_up(spark):
    at = dt.datetime(2010, 1, 1, 5)
    data = [(1, at, 1.0, 10), (1, at + dt.timedelta(minutes=30), 2.0, 20), (1, at + dt.timedelta(hours=1), None, 30)]
    df = spark.createDataFrame(data, "meter_id int, time timestamp_ntz, value double, temp int")
    assert rows(to_hourly(df, firsts=("temp",)), "time") == [(1, at, 10, 3.0), (1, at + dt.timedelta(hours=1), 30, 0.0)]
    assert rows(to_daily(df), "date") == [(1, dt.date(2010, 1, 1), 3.0)]
    assert to_steps(df, ["meter_id"], "time", "value", 900).count() == 3


def test_codes_range_ids_and_first(spark):
    df = spark.createDataFrame([("2", "19503", 0.21, 1), ("2", "19503", 0.20, 2), ("1", "19549", 0.3, 3)], "id string, code string, value double, n int")
    assert code_range(df).first() == ("19503", "19549")
    assert [r.id for r in distinct_ids(df).collect()] == ["1", "2"]
    assert rows(first_per_key(df, ("id", "code"), ("n",)).select("id", "value"), "id") == [("1", 0.3), ("2", 0.21)]
    assert rows(first_per_key(df, ("id", "code"), ("value", "n")).select("id", "value"), "id") == [("1", 0.3), ("2", 0.20)]
    assert df.where(off_grid(F.col("code"))).count() == 1


def test_totals_and_clusters(spark):
    at = dt.datetime(2010, 1, 1)
    data = [(m, p, at + dt.timedelta(hours=p), float(m + p)) for m in range(4) for p in range(3)]
    series = spark.createDataFrame(data, "meter_id int, pos long, time timestamp_ntz, value double")
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "meter_id int, clust_id int")
    parts = cluster_totals(series, clusters)
    assert rows(parts.select("clust_id", "pos", "value"), "clust_id", "pos")[:3] == [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 5.0)]
    whole = rows(cluster_totals(series).select("pos", "value"), "pos")
    assert whole == rows(parts.groupBy("pos").agg(F.sum("value")), "pos")
    assert single_cluster(series).where("clust_id = 0").count() == 4
    wide = to_wide(series, [0, 1, 2, 3], ("time",))
    assert wide.columns == ["time", "h0", "h1", "h2", "h3"] and to_long(wide, ["h0", "h3"]).count() == 6


def test_moving_average_edges(spark):
    def trend(values, k):
        df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "clust_id int, pos int, value double")
        return [r.trend for r in decompose(df, k).orderBy("pos").collect()]

    assert trend([1, 2, 3, 4, 5], 3) == pytest.approx([4 / 3, 2, 3, 4, 14 / 3])
    values, k = [3.0, 1.0], 7
    padded = [3.0] * 3 + values + [1.0] * 3
    assert trend(values, k) == pytest.approx([sum(padded[i:i + k]) / k for i in range(2)])
    with pytest.raises(ValueError):
        moving_average(spark.range(1), 4)


def test_lags(spark):
    df = spark.createDataFrame([(1, p, float(p)) for p in range(8)], "meter_id int, pos int, temp double")
    got = day_lags(df, ("temp",), steps_per_day=2, days=3).where("pos = 6").first()
    assert (got.temp_d1_t_, got.temp_d2_t_, got.temp_d3_t_) == (4.0, 2.0, 0.0)
    assert skip_steps() == 7
    series = df.select(F.col("meter_id").alias("clust_id"), "pos", F.col("temp").alias("value"))
    targets = series.select("clust_id", "pos").where("pos >= 5").withColumn("base_pos", F.col("pos") - 1)
    assert [r.skip_lags for r in seasonal_lags(targets, series, skip=2, count=2).orderBy("pos").collect()] == [[3, 1], [4, 2], [5, 3]]


def test_sample_is_repeatable_and_whole(spark):
    df = spark.range(50).selectExpr("id % 10 meter_id", "id")
    once = rows(sample_meters(df, 4, 7), "id")
    assert once == rows(sample_meters(df.repartition(3), 4, 7), "id") and len(once) == 20


def test_positions_in_blocks(spark):
    df = spark.range(1000).selectExpr("id * 3 o", "case when id % 3 = 0 then 'hot' else cast(id % 7 as string) end k")
    want = df.toPandas().sort_values("o")
    want["pos"] = want.groupby("k").cumcount()
    for block in (number_block("o", 64), even_block(df, "o", 16), F.lit(0)):
        got = positions(df, ["k"], ["o"], block).toPandas().sort_values("o")
        assert got["pos"].tolist() == want["pos"].tolist()
    whole = positions(df, [], ["o"], number_block("o", 100)).toPandas().sort_values("o")
    assert whole["pos"].tolist() == list(range(1000))


def rollover_by_hand(clock):
    group, groups = 0, []
    for i, c in enumerate(clock):
        group += i > 0 and c < clock[i - 1]
        groups.append(group)
    major = min(set(groups), key=lambda g: (-groups.count(g), g))
    return [c + dt.timedelta(days=(g > major) - (g < major)) for c, g in zip(clock, groups)]


def test_day_rollover(spark):
    day = dt.datetime(2010, 5, 1)
    clock = [day + dt.timedelta(hours=23, minutes=30)] + [day + dt.timedelta(minutes=30 * i) for i in range(48)] + [day]
    rng = np.random.default_rng(5)
    noisy = [day + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 1440, 200)]
    tied = [day + dt.timedelta(hours=h) for h in (3, 4, 1, 2)]
    pages = {"a": clock, "b": noisy, "c": tied, "d": [day]}
    data = [(s, i, t) for s, page in pages.items() for i, t in enumerate(page)]
    obs = spark.createDataFrame(data, "station string, n long, time timestamp_ntz")
    for block in (None, number_block("n", 1), number_block("n", 7)):
        got = day_rollover(obs, ["station"], "n", block=block)
        for s, page in pages.items():
            assert [r.time for r in got.where(F.col("station") == s).orderBy("n").collect()] == rollover_by_hand(page)
    first, last = rollover_by_hand(clock)[0], rollover_by_hand(clock)[-1]
    assert first.day == 30 and last.day == 2


def test_major_group_ties(spark):
    df = spark.createDataFrame([("x", 0, 2), ("x", 1, 3), ("x", 2, 3)], "k string, grp int, cnt int")
    assert major_group(df, ["k"]).first().major == 1


def test_clean_observations(spark):
    cells = spark.createDataFrame(
        [(dt.date(2010, 1, 2), "12:30 AM", "45 F", "40 F", "87 %", "WSW", "14 mph", "0 mph", "29.92 in", "0.0 in", "Cloudy")],
        "date date, `Time` string, `Temperature` string, `Dew Point` string, `Humidity` string, `Wind` string, `Wind Speed` string,"
        "`Wind Gust` string, `Pressure` string, `Precip.` string, `Condition` string")
    got = clean_observations(cells).first()
    assert (got.time, got.temperature, got.humidity, got.wind, got.pressure, got.condition) == (
        dt.datetime(2010, 1, 2, 0, 30), 45.0, 87.0, "WSW", 29.92, "Cloudy")


def test_joins_with_hot_keys(spark):
    facts = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id end k", "id v")
    dimension = spark.range(0, 3000, 2).selectExpr("id k", "id * 10 w")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, facts.join(dimension, "k", how).collect()))
        assert sorted(map(str, salted_join(facts, dimension, "k", "v", how, 16).collect())) == want
        hot = hot_join(facts, dimension, "k", "v", how, share=50, least=0)
        assert sorted(map(str, hot.collect())) == want
    spread = hot_join(facts, dimension.where("k = 0"), "k", "v", share=50, least=0)
    assert spread.count() == 1000


def test_keep_allocated(spark):
    readings = spark.createDataFrame([("1", "19501", 1.0), ("2", "19501", 2.0), ("3", "19501", 3.0)], "id string, code string, value double")
    alloc = spark.createDataFrame([("1", "1"), ("1", "2"), ("2", "3"), ("3", "2")], "id string, code string")
    assert rows(keep_allocated(readings, alloc).select("id", "value"), "id") == [("1", 1.0), ("3", 3.0)]
    hot = spark.range(3000).selectExpr("cast(if(id % 3 = 0, 1, id) as string) id", "cast(id as string) code", "id * 1.0 value")
    kept = keep_allocated(hot, alloc, least=100)  # the meter with a third of the readings is spread
    assert kept.count() == 1001 and kept.where("id = 1").selectExpr("count(distinct code)").first()[0] == 1001 - kept.where("id = 3").count()


def test_climate_join_rejects_repeated_days(spark):
    days = spark.createDataFrame([(dt.date(2010, 1, 1),), (dt.date(2010, 1, 2),)], "date date")
    climate = spark.createDataFrame([(dt.date(2010, 1, 1), 5.0)], "date date, temp_max double")
    assert rows(join_climate(days, climate), "date") == [(dt.date(2010, 1, 1), 5.0), (dt.date(2010, 1, 2), None)]
    with pytest.raises(Exception, match="more than one climate row"):
        join_climate(days, climate.unionAll(climate)).collect()
    left = spark.createDataFrame([(1, "a"), (2, "b")], "time int, x string")
    assert rows(beside(left, left.withColumnRenamed("x", "y")), "time") == [(1, "a", "a"), (2, "b", "b")]
