"""Joins of readings with dimensions.

No join here carries a broadcast hint: Catalyst broadcasts a side only when its estimated or measured
size is below ``spark.sql.autoBroadcastJoinThreshold``, and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT = 1 << 16


def salt_of(columns: Sequence[str], parts: Column) -> Column:
    """Part number from a hash of the columns; never null, so no filter on it is needed."""
    return F.coalesce(F.pmod(F.xxhash64(*columns), parts).cast("int"), F.lit(0))


def salted_join(facts: DataFrame, dimension: DataFrame, key: str | Sequence[str], spread_by: str | Sequence[str],
                how: str, salts: int) -> DataFrame:
    """Equi join in which the rows of every fact key are spread over ``salts`` tasks, where that number is known to fit.

    The salt is a hash of fact columns, so a repeated task gives the same rows; each dimension row is
    repeated once per salt. Works for inner, left, left_semi and left_anti joins.
    """
    keys = [key] if isinstance(key, str) else list(key)
    by = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    wide = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn("_salt", salt_of(by, F.lit(salts))).join(wide, [*keys, "_salt"], how).drop("_salt")


def hot_join(facts: DataFrame, dimension: DataFrame, key: str | Sequence[str], spread_by: str | Sequence[str],
             how: str = "inner", share: int = 1000, least: int = HOT) -> DataFrame:
    """Equi join that salts only the hot fact keys.

    A key is hot when it holds more than 1/``share`` of the facts (and more than ``least`` rows), so there are
    fewer than ``share`` hot keys whatever the data; this is the only table broadcast. Each hot key is cut into
    parts below that size, and its dimension rows are repeated once per part. The facts are read twice.
    """
    keys = [key] if isinstance(key, str) else list(key)
    by = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    limit = F.greatest(facts.agg(F.count("*").alias("n")).scalar() / share, F.lit(least))
    counts = facts.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted = facts.join(hot, keys, "left").withColumn("_salt", salt_of(by, parts)).drop("_parts")
    wide = dimension.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(wide, [*keys, "_salt"], how).drop("_salt")


def sized_join(facts: DataFrame, dimension: DataFrame, key: str | Sequence[str], spread_by: str | Sequence[str],
               largest: int, how: str = "inner") -> DataFrame:
    """Plain equi join where no fact key can hold more than HOT rows, else one that salts the hot keys.

    ``largest`` is a known bound of the rows per key.
    """
    if largest <= HOT:
        return facts.join(dimension, key, how)
    return hot_join(facts, dimension, key, spread_by, how, least=HOT)


def keep_allocated(readings: DataFrame, allocations: DataFrame, codes: Sequence[str] = ("1", "2"),
                   key: str = "id", code: str = "code", least: int = HOT) -> DataFrame:
    """Readings of meters that belong to one of the customer classes.

    The readings of each meter are counted; only a meter with too many for one task is spread, by its other columns, over
    as many parts as its number asks for.
    """
    spread_by = [c for c in readings.columns if c != key]
    meters = allocations.where(F.col(code).isin(*codes)).select(key).distinct()
    return hot_join(readings, meters, key, spread_by, "left_semi", least=least)


def join_climate(calendar: DataFrame, climate: DataFrame, date: str = "date") -> DataFrame:
    """Calendar rows with the weather of their day; fails at run time if a day occurs twice."""
    values = [c for c in climate.columns if c != date]
    unique = climate.groupBy(date).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in values])
    repeated = F.concat(F.lit("more than one climate row for "), F.col(date).cast("string"))
    checked = unique.select(
        F.when(F.col("_n") == 1, F.col(date)).otherwise(F.raise_error(repeated).cast("date")).alias(date), *values)
    return calendar.join(checked, date, "left")


def beside(left: DataFrame, right: DataFrame, time: str = "time") -> DataFrame:
    """Columns of two tables side by side, matched on time."""
    return left.join(right, time)


def attach_actuals(forecasts: DataFrame, series: DataFrame, keys: Sequence[str] = ("clust_id",),
                   value: str = "value") -> DataFrame:
    """Actual value and time of each forecast position; positions without a value are left out."""
    actual = series.where(F.col(value).isNotNull()).select(*keys, "pos", "time", F.col(value).alias("act_val"))
    return forecasts.join(actual, [*keys, "pos"])
