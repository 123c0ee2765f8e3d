import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wattloom.conf import ForecastConf
from wattloom.functions.calendar import time_marks
from wattloom.operators.split import (
    Split, base_positions, bootstrap_bases, check_season, every_nth, except_positions, in_season, intersect_positions,
    season_gaps, season_index, split_point, train_bases)
from wattloom.operators.windows import decoder_seed, gather, gather_steps, horizon_targets, sequence_window, window_trend


def index_of(spark, start, hours):
    data = [(i, start + dt.timedelta(hours=i)) for i in range(hours)]
    return spark.createDataFrame(data, "pos long, time timestamp_ntz")


def days_index(spark, start, days):
    return spark.createDataFrame([(i, start + dt.timedelta(days=i)) for i in range(days)], "pos long, time timestamp_ntz")


def split_by_hand(times, conf):
    """The same index sets with plain lists."""
    season = [i for i, t in enumerate(times) if (t.month in conf.summer_months) == (conf.season == "summer")]
    inside = set(season)
    bases = [i for i in season if i - conf.prev_times in inside and i + conf.next_times in inside]
    start = min(i for r, i in enumerate(bases)
                if r / (len(bases) - 1) > 1 - conf.test_ratio and times[i].hour == 0 and times[i].minute == 0)
    late = [i for i in bases if i >= start - 1]
    return season, bases, start, [i for i in bases if i < start], late[:: conf.next_times]


@pytest.mark.parametrize("season", ["summer", "winter"])
def test_split_matches_lists(spark, season):
    conf = ForecastConf(season=season, prev_times=10, next_times=4)
    start = dt.datetime(2009, 7, 14)
    split = Split(days_index(spark, start, 800), conf)
    times = [start + dt.timedelta(days=i) for i in range(800)]
    inside, bases, at, train, test = split_by_hand(times, conf)
    assert [r.pos for r in split.season.orderBy("pos").collect()] == inside
    assert [r.pos for r in split.bases.orderBy("pos").collect()] == bases
    assert split.start.first().test_start == at and split_point(split.bases, conf).first().test_start == at
    assert [r.pos for r in split.train.orderBy("pos").collect()] == train
    assert [r.pos for r in split.test.orderBy("pos").collect()] == test
    assert rows(split.roles.select("pos", "role"), "pos") == [(i, "train" if i < at else "test") for i in inside]
    assert split.base_roles().count() == len(train) + len(test)
    purged = [r.pos for r in train_bases(split.bases, split.start.scalar(), 4, purge=True).orderBy("pos").collect()]
    assert purged == [i for i in train if i + 4 < at]
    steps = np.diff(np.array(inside))
    want = [(inside[i + 1], int(s)) for i, s in enumerate(steps) if s > 1]
    assert rows(season_gaps(split.season), "pos") == want
    check_season(split.season, conf)
    with pytest.raises(ValueError, match="prev_times"):
        check_season(split.season, ForecastConf(season=season, prev_times=400))


def test_split_refuses_windows_across_a_gap_and_samples_by_seed(spark):
    index = days_index(spark, dt.datetime(2009, 7, 14), 800)
    with pytest.raises(ValueError, match="prev_times"):
        Split(index, ForecastConf(prev_times=300, next_times=4))
    conf = ForecastConf(prev_times=10, next_times=4, train_sample_ratio=0.5)
    drawn = [[r.pos for r in Split(index, conf, seed=s).training_sample().collect()] for s in (0, 0, 1)]
    assert drawn[0] == drawn[1] != drawn[2]


def test_one_segment_season_is_valid(spark):
    index = index_of(spark, dt.datetime(2010, 6, 1), 100)
    conf = ForecastConf(prev_times=192)
    check_season(season_index(index, conf), conf)
    assert season_gaps(season_index(index, conf)).isEmpty()


def test_quantile_rule(spark):
    index = index_of(spark, dt.datetime(2010, 6, 1), 240)
    ten = index.where("pos % 24 = 0")
    assert split_point(ten, ForecastConf()).first().test_start == 8 * 24
    assert [r.pos for r in every_nth(ten, 4).orderBy("pos").collect()] == [0, 96, 192]


def test_sets_and_season(spark):
    index = days_index(spark, dt.datetime(2010, 3, 30), 5)
    assert [r.s for r in index.orderBy("pos").select(in_season(F.col("time"), (4,), "summer").alias("s")).collect()] == [False, False, True, True, True]
    left, right = index.where("pos < 3"), index.where("pos > 1")
    assert [r.pos for r in intersect_positions(left, right).collect()] == [2]
    assert sorted(r.pos for r in except_positions(left, right).collect()) == [0, 1]
    assert base_positions(index, 2, 1).select("pos").orderBy("pos").collect() == [(2,), (3,)]


def test_bootstrap_size_and_repeatability(spark):
    train = days_index(spark, dt.datetime(2010, 6, 1), 100)
    draw = [r.pos for r in bootstrap_bases(train, 130, 0.5, 3).collect()]
    assert len(draw) == 65 and draw == sorted(draw) and len(set(draw)) < 65 and set(draw) <= set(range(100))
    assert draw == [r.pos for r in bootstrap_bases(train.repartition(7), 130, 0.5, 3).collect()]
    assert draw != [r.pos for r in bootstrap_bases(train, 130, 0.5, 4).collect()]
    assert bootstrap_bases(train, 130, 1.0).count() == 100


def test_windows_and_targets(spark):
    data = [(c, p, float(100 * c + p), dt.datetime(2010, 1, 1) + dt.timedelta(hours=p)) for c in range(2) for p in range(30)]
    series = spark.createDataFrame(data, "clust_id int, pos long, value double, time timestamp_ntz")
    whole = sequence_window(series, 5, 3)
    got = {(r.clust_id, r.pos): (r.value_prev, r.value_next) for r in whole.collect()}
    assert len(got) == 2 * (30 - 4 - 3)
    assert got[(1, 10)] == ([106, 107, 108, 109, 110], [111, 112, 113])
    bases = spark.createDataFrame([(10,), (2,), (26,), (28,)], "pos long")
    some = gather(series, bases, 5, 3).orderBy("clust_id", "base_pos").collect()
    assert [(r.clust_id, r.base_pos) for r in some] == [(0, 10), (0, 26), (1, 10), (1, 26)]
    assert (some[2].prev, some[2].next) == got[(1, 10)]
    long = horizon_targets(series, bases.where("pos = 10"), 3).where("clust_id = 0")
    assert rows(long.select("base_pos", "horizon", "pos", "target"), "horizon") == [(10, h, 10 + h, 10.0 + h) for h in (1, 2, 3)]
    marks = series.withColumns(time_marks(F.col("time")))
    marked = sequence_window(marks, 3, 1, columns=("value", "month", "day", "weekday", "hour")).where("clust_id = 0 and pos = 24").first()
    assert marked.hour_prev == [22, 23, 0] and marked.day_prev == [1, 1, 2] and marked.weekday_next == [5] and marked.month_prev == [1, 1, 1]


def test_steps_carry_marks(spark):
    start = dt.datetime(2010, 1, 1)
    series = spark.createDataFrame([(0, p, start + dt.timedelta(hours=p), None if p == 9 else float(p)) for p in range(30)], "clust_id int, pos long, time timestamp_ntz, value double")
    marked = series.withColumns(time_marks(F.col("time")))
    bases = spark.createDataFrame([(10,), (1,), (28,)], "pos long")
    got = gather_steps(marked, bases, 3, 2, ["value", "day", "hour"]).collect()
    assert [(r.base_pos, [tuple(s) for s in r.prev], [tuple(s) for s in r.next]) for r in got] == [
        (10, [(8.0, 1, 8), (None, 1, 9), (10.0, 1, 10)], [(11.0, 1, 11), (12.0, 1, 12)])]


def test_window_trend_and_seed(spark):
    values = [float(v) for v in np.random.default_rng(2).normal(size=16)]
    k, half = 5, 2
    padded = np.array([values[0]] * half + values + [values[-1]] * half)
    trend = np.convolve(padded, np.ones(k) / k, "valid")
    df = spark.createDataFrame([(1, values)], "base_pos int, prev array<double>")
    got = df.select(window_trend(F.col("prev"), k, 16).alias("t")).first().t
    np.testing.assert_allclose(got, trend)
    seed = decoder_seed(df, "prev", 16, k, 4, 3).first()
    np.testing.assert_allclose(seed.trend_seed, np.r_[trend[-4:], [np.mean(values)] * 3])
    np.testing.assert_allclose(seed.seasonal_seed, np.r_[(np.array(values) - trend)[-4:], [0.0] * 3])
    with pytest.raises(ValueError):
        window_trend(F.col("prev"), 4, 16)
