"""Meter time codes, grid positions and date sequences.

A code has five characters: three for the day (001 = 2009-01-01) and two for the half-hour
tick (01 = 00:00). Times are TIMESTAMP_NTZ throughout, so no result depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Origin of the meter code calendar and length of one tick.
CODE_ORIGIN = "2009-01-01"
TICK_MINUTES = 30
TICKS_PER_DAY = 48


def ntz(time: Column) -> Column:
    return time.cast("timestamp_ntz")


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970-01-01 of a zone-free timestamp."""
    days = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def from_epoch_seconds(seconds: Column) -> Column:
    return ntz(F.lit("1970-01-01 00:00:00")) + F.expr("interval 1 second") * seconds


def step_index(time: Column, step_seconds: int) -> Column:
    """Number of whole steps since 1970-01-01 00:00: a grid position without any sort."""
    days = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    for unit, part in ((86400, days), (3600, days * 24 + F.hour(time))):
        if step_seconds % unit == 0:
            return part if step_seconds == unit else F.floor(part / (step_seconds // unit))
    return F.floor(epoch_seconds(time) / step_seconds)


def step_time(index: Column, step_seconds: int) -> Column:
    return from_epoch_seconds(index * step_seconds)


def floor_time(time: Column, step_seconds: int = 3600) -> Column:
    """Round a timestamp down to a multiple of the step, counted from 1970-01-01 00:00."""
    return step_time(step_index(time, step_seconds), step_seconds)


def decode_code(code: Column) -> Column:
    """Start time of a code; ticks above 48 run past midnight, malformed codes give null."""
    day = F.substring(code, 1, 3).try_cast("int")
    tick = F.substring(code, 4, 10).try_cast("int")
    zero = F.lit(0)
    span = F.make_dt_interval(day - 1, zero, (tick - 1) * TICK_MINUTES)
    return ntz(F.lit(CODE_ORIGIN)) + span


def encode_code(time: Column) -> Column:
    """Inverse of ``decode_code`` on the half-hour grid, both parts padded; null outside days 1 to 999."""
    day = F.datediff(time.cast("date"), F.lit(CODE_ORIGIN).cast("date")) + 1
    tick = F.hour(time) * 2 + F.floor(F.minute(time) / TICK_MINUTES) + 1
    code = F.concat(F.lpad(day.cast("string"), 3, "0"), F.lpad(tick.cast("string"), 2, "0"))
    return F.when(day.between(1, 999), code)


def off_grid(code: Column) -> Column:
    """True for codes that match no grid row: malformed ones, and ticks before or past the half hours of a day."""
    tick = F.substring(code, 4, 10).try_cast("int")
    return F.coalesce(decode_code(code).isNull() | (tick < 1) | (tick > TICKS_PER_DAY), F.lit(True))


def time_grid(bounds: DataFrame, start: str, end: str, step_seconds: int = 1800, out: str = "time") -> DataFrame:
    """One row per step between two timestamp columns, both ends included."""
    first, last = epoch_seconds(F.col(start)), epoch_seconds(F.col(end))
    steps = F.explode(F.sequence(first, last, F.lit(step_seconds).cast("long"))).alias("_s")
    kept = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*kept, steps).select(*kept, from_epoch_seconds(F.col("_s")).alias(out))


def code_grid(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """Half-hour grid with the code of each step."""
    grid = time_grid(bounds, start, end, TICK_MINUTES * 60)
    return grid.withColumn("code", encode_code(F.col("time")))


def date_list(bounds: DataFrame, start: str, end: str, out: str = "date") -> DataFrame:
    """One row per day between two date columns, both ends included."""
    days = F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr("interval 1 day"))
    kept = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*kept, F.explode(days).alias(out))
