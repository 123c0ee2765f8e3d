"""Samples of a regular series: targets per horizon and window arrays per base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def horizon_targets(series: DataFrame, bases: DataFrame, next_times: int, keys: Sequence[str] = ("clust_id",),
                    value: str = "value") -> DataFrame:
    """For each base b and horizon h = 1..next_times the value at b + h: keys, base_pos, horizon, pos, target."""
    steps = bases.select(
        F.col("pos").alias("base_pos"), F.explode(F.sequence(F.lit(1), F.lit(next_times))).alias("horizon"))
    steps = steps.withColumn("pos", F.col("base_pos") + F.col("horizon"))
    values = series.select(*keys, "pos", F.col(value).alias("target"))
    return values.join(steps, "pos")


def sequence_window(series: DataFrame, prev_times: int, next_times: int, keys: Sequence[str] = ("clust_id",),
                    columns: Sequence[str] = ("value",)) -> DataFrame:
    """Arrays of the last prev_times and the next next_times values at every position with full windows.

    Column c gives ``c_prev`` and ``c_next``; the first array ends with the value at the base itself.
    Nulls inside a window are not kept by the arrays, so series must be filled.
    """
    along = W.partitionBy(*keys).orderBy("pos")
    back, ahead = along.rowsBetween(-(prev_times - 1), 0), along.rowsBetween(1, next_times)
    arrays = {}
    for c in columns:
        arrays[f"{c}_prev"] = F.collect_list(c).over(back)
        arrays[f"{c}_next"] = F.collect_list(c).over(ahead)
    first = f"{columns[0]}"
    full = (F.size(f"{first}_prev") == prev_times) & (F.size(f"{first}_next") == next_times)
    return series.withColumns(arrays).where(full)


def gather(series: DataFrame, bases: DataFrame, prev_times: int, next_times: int,
           keys: Sequence[str] = ("clust_id",), value: str = "value") -> DataFrame:
    """The same arrays for the asked bases only: keys, base_pos, prev, next.

    Offsets are written out per base and joined on position, so the work grows with the number of bases
    and a group never holds more than prev_times + next_times rows.
    """
    offsets = F.explode(F.sequence(F.lit(1 - prev_times), F.lit(next_times)))
    asked = bases.select(F.col("pos").alias("base_pos"), offsets.alias("_k"))
    asked = asked.withColumn("pos", F.col("base_pos") + F.col("_k"))
    rows = series.select(*keys, "pos", F.col(value).alias("_v")).join(asked, "pos")
    step = F.struct("_k", "_v")
    grouped = rows.groupBy(*keys, "base_pos").agg(F.sort_array(F.collect_list(step)).alias("_w"))
    prev = F.transform(F.filter("_w", lambda s: s["_k"] <= 0), lambda s: s["_v"])
    ahead = F.transform(F.filter("_w", lambda s: s["_k"] > 0), lambda s: s["_v"])
    arrays = grouped.select(*keys, "base_pos", prev.alias("prev"), ahead.alias("next"))
    return arrays.where((F.size("prev") == prev_times) & (F.size("next") == next_times))


def gather_steps(series: DataFrame, bases: DataFrame, prev_times: int, next_times: int, columns: Sequence[str],
                 keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """Value and marks of every window step of the asked bases in one gather: keys, base_pos, prev, next.

    A step is a struct of ``columns`` (for example the value and the time marks); nulls inside a step stay, and bases whose
    window leaves the series are left out.
    """
    packed = series.select(*keys, "pos", F.struct(*columns).alias("_step"))
    return gather(packed, bases, prev_times, next_times, keys, "_step")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda a, b: a * b))


def window_trend(values: Column, k: int, length: int) -> Column:
    """Centred mean of odd length k inside one window array of the given length, edges repeated."""
    if k < 1 or k % 2 == 0:
        raise ValueError(f"the kernel length must be odd, got {k}")
    half = (k - 1) // 2
    padded = F.concat(
        F.array_repeat(F.element_at(values, 1), half), values, F.array_repeat(F.element_at(values, -1), half))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: array_sum(F.slice(padded, i, k)) / k)


def decoder_seed(windows: DataFrame, prev: str = "prev", length: int = 192, k: int = 11, label_len: int = 12,
                 pred_len: int = 24) -> DataFrame:
    """Start of a decoder input per window: ``trend_seed`` and ``seasonal_seed``.

    The last label_len steps of trend and seasonal part, then the window mean or zeros for pred_len steps.
    """
    parts = windows.withColumn("_trend", window_trend(F.col(prev), k, length))
    tail = F.slice("_trend", length - label_len + 1, label_len)
    rest = F.zip_with(F.slice(prev, length - label_len + 1, label_len), tail, lambda v, t: v - t)
    return parts.withColumns({
        "trend_seed": F.concat(tail, F.array_repeat(array_mean(F.col(prev)), pred_len)),
        "seasonal_seed": F.concat(rest, F.array_repeat(F.lit(0.0), pred_len)),
    }).drop("_trend")
