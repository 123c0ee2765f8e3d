"""Regular series per meter: roll-up, gap filling, totals, lags and trend.

Readings are first aggregated to one row per meter and step, which Spark combines before the shuffle.
After that a meter has at most one row per grid step, so windows over a meter have a fixed bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.functions.timecode import floor_time, step_index, step_time


def code_range(readings: DataFrame, code: str = "code") -> DataFrame:
    """Smallest and largest code by text order, which is time order for codes of fixed width."""
    return readings.agg(F.min(code).alias("start_code"), F.max(code).alias("end_code"))


def distinct_ids(readings: DataFrame, key: str = "id") -> DataFrame:
    return readings.select(key).distinct().orderBy(key)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by an explicit order: an aggregate, so copies are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, rank).alias(c) for c in rest])


def to_steps(df: DataFrame, keys: Sequence[str], time: str, value: str, step_seconds: int = 3600,
             firsts: Sequence[str] = ()) -> DataFrame:
    """Sum per step; time variables come from the earliest row of the step. A step of nulls sums to 0."""
    total = F.sum(value)
    sums = F.coalesce(total, F.lit(0)).alias(value)
    heads = [F.min_by(c, time).alias(c) for c in firsts]
    return df.groupBy(*keys, floor_time(F.col(time), step_seconds).alias("_t")).agg(*heads, sums) \
        .withColumnRenamed("_t", time)


def to_hourly(df: DataFrame, keys: Sequence[str] = ("meter_id",), time: str = "time", value: str = "value",
              firsts: Sequence[str] = ()) -> DataFrame:
    return to_steps(df, keys, time, value, 3600, firsts)


def to_daily(df: DataFrame, keys: Sequence[str] = ("meter_id",), time: str = "time", value: str = "value") -> DataFrame:
    day = F.col(time).cast("date").alias("date")
    return df.groupBy(*keys, day).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def step_totals(df: DataFrame, keys: Sequence[str], time: str, value: str, step_seconds: int) -> DataFrame:
    """Sum per key and absolute step number ``step``."""
    step = step_index(F.col(time), step_seconds).alias("step")
    return df.groupBy(*keys, step).agg(F.coalesce(F.sum(value), F.lit(0)).cast("double").alias(value))


def step_bounds(df: DataFrame, step: str = "step") -> DataFrame:
    return df.agg(F.min(step).alias("lo"), F.max(step).alias("hi"))


def fill_gaps(df: DataFrame, key: str, step: str, value: str, lo: Column, hi: Column) -> DataFrame:
    """Value of every key at every step from ``lo`` to ``hi``.

    Gaps are interpolated linearly, a leading gap takes the first known value, a trailing one the last;
    a key without any value stays null. ``df`` has one row per key and step.

    The grid is never joined: each known row knows its successor and writes the steps up to it, so only
    known rows are shuffled and sorted, once.
    """
    known = F.col(value).isNotNull()
    along = W.partitionBy(key).orderBy((~known).cast("int"), step)
    near = df.select(
        key, step, value,
        F.row_number().over(along).alias("_rn"),
        F.lead(F.when(known, F.col(step))).over(along).alias("_next"),
        F.lead(value).over(along).alias("_next_value"),
    ).where(known | (F.col("_rn") == 1))
    begin = F.when(F.col("_rn") == 1, lo).otherwise(F.col(step))
    end = F.when(F.col("_next").isNull(), hi).otherwise(F.col("_next") - 1)
    spread = near.withColumn("_at", F.explode(F.sequence(begin, end)))
    rise = (F.col("_next_value") - F.col(value)) * (F.col("_at") - F.col(step)) / (F.col("_next") - F.col(step))
    filled = F.when((F.col("_at") <= F.col(step)) | F.col("_next").isNull(), F.col(value)).otherwise(F.col(value) + rise)
    return spread.select(key, F.col("_at").alias(step), filled.alias(value))


def regular_series(readings: DataFrame, key: str = "meter_id", time: str = "time", value: str = "value",
                   step_seconds: int = 3600, span: tuple[Column, Column] | None = None) -> DataFrame:
    """Roll up to steps, align every meter to the common grid and fill gaps: key, pos, time, value.

    ``pos`` is the 0-based grid position, computed from the time without a sort. The grid runs over ``span``,
    two timestamp columns, or else from the first to the last reading, which reads the time column once more.
    """
    steps = step_totals(readings, [key], time, value, step_seconds)
    if span is None:
        lo = readings.agg(step_index(F.min(time), step_seconds).alias("lo")).scalar()
        hi = readings.agg(step_index(F.max(time), step_seconds).alias("hi")).scalar()
    else:
        lo, hi = (step_index(t, step_seconds) for t in span)
    filled = fill_gaps(steps, key, "step", value, lo, hi)
    return filled.select(
        key, (F.col("step") - lo).alias("pos"), step_time(F.col("step"), step_seconds).alias("time"), value)


def grid_index(readings: DataFrame, time: str = "time", step_seconds: int = 3600) -> DataFrame:
    """Position and time of every grid step between the first and last reading."""
    bounds = readings.agg(step_index(F.min(time), step_seconds).alias("lo"), step_index(F.max(time), step_seconds).alias("hi"))
    steps = bounds.select("lo", F.explode(F.sequence("lo", "hi")).alias("step"))
    return steps.select((F.col("step") - F.col("lo")).alias("pos"), step_time(F.col("step"), step_seconds).alias("time"))


def single_cluster(meters: DataFrame, key: str = "meter_id") -> DataFrame:
    return meters.select(key).distinct().withColumn("clust_id", F.lit(0))


def cluster_totals(series: DataFrame, clusters: DataFrame | None = None, key: str = "meter_id",
                   value: str = "value") -> DataFrame:
    """Sum of the meters of each cluster at each step; without a cluster map all meters form cluster 0."""
    mapped = series.withColumn("clust_id", F.lit(0)) if clusters is None else series.join(clusters, key)
    return mapped.groupBy("clust_id", "pos", "time").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def day_lags(series: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("meter_id",), pos: str = "pos",
             steps_per_day: int = 24, days: int = 7) -> DataFrame:
    """Columns ``<name>_d<k>_t_``: the value k days earlier on the gap-free grid, k = 1..days."""
    along = W.partitionBy(*keys).orderBy(pos)
    lags = {f"{c}_d{k}_t_": F.lag(c, k * steps_per_day).over(along) for c in columns for k in range(1, days + 1)}
    return series.withColumns(lags)


def skip_steps(prev_times: int = 192, kernel: int = 6, skip: int = 24) -> int:
    """How many whole skips fit between the window start and the convolution kernel."""
    return (prev_times - kernel) // skip


def seasonal_lags(targets: DataFrame, series: DataFrame, keys: Sequence[str] = ("clust_id",), skip: int = 24,
                  count: int = 7, value: str = "value") -> DataFrame:
    """Array ``skip_lags`` of the values 1..count skips before each target position, nearest first."""
    along = W.partitionBy(*keys).orderBy("pos")
    lags = F.array(*[F.lag(value, skip * j).over(along) for j in range(1, count + 1)])
    seen = series.select(*keys, "pos", lags.alias("skip_lags"))
    return targets.join(seen, [*keys, "pos"])


def moving_average(series: DataFrame, k: int, keys: Sequence[str] = ("clust_id",), pos: str = "pos",
                   value: str = "value", out: str = "trend") -> DataFrame:
    """Centred mean of odd length k; both edges repeat the first or last value of the series."""
    if k < 1 or k % 2 == 0:
        raise ValueError(f"the kernel length must be odd, got {k}")
    half = (k - 1) // 2
    along = W.partitionBy(*keys).orderBy(pos)
    near = along.rowsBetween(-half, half)
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = F.row_number().over(along)
    missing_front = F.greatest(F.lit(0), half - rank + 1)
    missing_end = F.greatest(F.lit(0), rank + half - F.count("*").over(whole))
    padded = (F.sum(value).over(near) + missing_front * F.first(value).over(whole)
              + missing_end * F.last(value).over(whole))
    return series.withColumn(out, padded / k)


def decompose(series: DataFrame, k: int = 11, keys: Sequence[str] = ("clust_id",), pos: str = "pos",
              value: str = "value") -> DataFrame:
    """Trend and the rest, called seasonal."""
    smooth = moving_average(series, k, keys, pos, value)
    return smooth.withColumn("seasonal", F.col(value) - F.col("trend"))


def sample_meters(df: DataFrame, n: int, seed: int = 0, key: str = "meter_id") -> DataFrame:
    """Rows of n meters drawn without replacement; the draw depends on the meter ids and the seed only."""
    drawn = df.select(key).distinct().orderBy(F.md5(F.concat_ws(":", key, F.lit(seed))), key).limit(n)
    return df.join(drawn, key, "left_semi")


def first_steps(series: DataFrame, n: int = 300, time: str = "time") -> DataFrame:
    return series.orderBy(time).limit(n)


def to_long(wide: DataFrame, meters: Sequence[str], keys: Sequence[str] = ("time",)) -> DataFrame:
    """One row per time and meter from one column per meter."""
    return wide.unpivot(list(keys), list(meters), "meter_id", "value")


def to_wide(series: DataFrame, meters: Sequence, keys: Sequence[str] = ("time",), prefix: str = "h") -> DataFrame:
    """One column per listed meter; for export only."""
    pivoted = series.groupBy(*keys).pivot("meter_id", list(meters)).agg(F.first("value"))
    for m in meters:
        pivoted = pivoted.withColumnRenamed(str(m), f"{prefix}{m}")
    return pivoted
