"""Weather observations: clean fields, and times that run past midnight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.text import WEATHER_UNITS, obs_time, strip_unit
from wattloom.operators.ordered import drop_groups, number_block

# Table header of each observation column.
OBSERVATION_COLUMNS = {
    "temperature": "Temperature",
    "dew_point": "Dew Point",
    "humidity": "Humidity",
    "wind": "Wind",
    "wind_speed": "Wind Speed",
    "wind_gust": "Wind Gust",
    "pressure": "Pressure",
    "precip": "Precip.",
    "condition": "Condition",
}


def major_group(counts: DataFrame, keys: Sequence[str], group: str = "grp", count: str = "cnt") -> DataFrame:
    """The group with the most rows per key; of equal ones the smallest number."""
    rank = F.struct(F.col(count), -F.col(group))
    return counts.groupBy(*keys).agg(F.max_by(group, rank).alias("major"))


def day_rollover(obs: DataFrame, keys: Sequence[str], order: str, time: str = "time",
                 block: Column | None = None) -> DataFrame:
    """Move observations of the previous and next day that carry the date of their page.

    Per key, each drop of the clock starts a new day; the longest stretch keeps its date, stretches after
    it move one day ahead and stretches before it one day back. ``order`` is an integer without ties.
    A key of any size is scanned in blocks of ``order``.
    """
    keys = list(keys)
    rows, carry = drop_groups(obs, keys, order, time, number_block(order) if block is None else block)
    sizes = rows.groupBy(*keys, "_blk", "_run").agg(F.count("*").alias("_n"))
    counts = sizes.join(carry, [*keys, "_blk"]).groupBy(*keys, (F.col("_run") + F.col("_off")).alias("grp")).agg(
        F.sum("_n").alias("cnt"))
    carry = carry.join(major_group(counts, keys), keys)
    placed = rows.join(carry, [*keys, "_blk"]).withColumn("day_group", F.col("_run") + F.col("_off"))
    day = F.expr("interval 1 day")
    shifted = (
        F.when(F.col("day_group") > F.col("major"), F.col(time) + day)
        .when(F.col("day_group") < F.col("major"), F.col(time) - day)
        .otherwise(F.col(time))
    )
    return placed.withColumn(time, shifted).drop("_blk", "_run", "_off", "major")


def clean_observations(cells: DataFrame, date: str = "date", clock: str = "Time") -> DataFrame:
    """Typed columns from the text cells of a weather table; the time still has the date of the page."""
    typed = {"time": obs_time(F.col(date), F.col(clock))}
    for name, header in OBSERVATION_COLUMNS.items():
        cell = F.col(f"`{header}`")
        typed[name] = strip_unit(cell, WEATHER_UNITS[name]) if name in WEATHER_UNITS else cell
    headers = {clock, *OBSERVATION_COLUMNS.values()}
    kept = [F.col(f"`{c}`") for c in cells.columns if c not in headers]
    return cells.select(*kept, *[column.alias(name) for name, column in typed.items()])
