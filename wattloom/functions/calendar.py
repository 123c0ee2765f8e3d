"""Calendar features of a timestamp column; every feature is a built-in expression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday flags in order Monday to Saturday; Sunday is the case where all are 0.
WEEKDAY_FLAGS = ("mon_yn", "tue_yn", "wed_yn", "thu_yn", "fri_yn", "sat_yn")

# Public holidays and bank holidays of the metering area, 2009 to 2011.
HOLIDAYS = (
    "2009-01-01", "2009-03-17", "2009-04-10", "2009-04-12", "2009-04-13", "2009-05-04",
    "2009-06-01", "2009-08-03", "2009-10-26", "2009-12-24", "2009-12-25", "2009-12-26", "2009-12-31",
    "2010-01-01", "2010-03-17", "2010-04-02", "2010-04-04", "2010-04-05", "2010-05-03",
    "2010-06-07", "2010-08-02", "2010-10-25", "2010-12-24", "2010-12-25", "2010-12-26", "2010-12-31",
    "2011-01-01", "2011-03-17", "2011-04-22", "2011-04-24", "2011-04-25", "2011-05-02",
    "2011-06-06", "2011-08-01", "2011-10-31", "2011-12-24", "2011-12-25", "2011-12-26", "2011-12-31",
)


def date_parts(time: Column) -> dict[str, Column]:
    return {
        "date": time.cast("date"),
        "weekday": F.weekday(time),
        "year": F.year(time),
        "month": F.month(time),
        "day": F.day(time),
        "hour": F.hour(time),
        "minute": F.minute(time),
    }


def days_in_month(time: Column) -> Column:
    return F.day(F.last_day(time.cast("date")))


def cyclical(time: Column) -> dict[str, Column]:
    """Sine and cosine of the phase of the minute, hour, day and month."""
    phases = {
        "minute": F.minute(time) / 60.0,
        "hour": (F.hour(time) + F.minute(time) / 60.0) / 24.0,
        "day": F.day(time) / days_in_month(time),
        "month": F.month(time) / 12.0,
    }
    turn = 2 * math.pi
    out = {}
    for name, phase in phases.items():
        out[f"{name}_x"] = F.sin(phase * turn)
        out[f"{name}_y"] = F.cos(phase * turn)
    return out


def weekday_flags(time: Column) -> dict[str, Column]:
    return {name: (F.weekday(time) == k).cast("int") for k, name in enumerate(WEEKDAY_FLAGS)}


def calendar_features(df: DataFrame, time: str = "time") -> DataFrame:
    """Date, cyclical features and weekday flags next to each time."""
    at = F.col(time)
    columns = {"date": at.cast("date"), **cyclical(at), **weekday_flags(at)}
    return df.withColumns(columns)


def holiday_flag(df: DataFrame, holidays: DataFrame, date: str = "date", out: str = "holiday_yn") -> DataFrame:
    """1 where the date occurs in the holiday table (one column ``date``), else 0.

    The distinct holidays are broadcast: a date column has fewer than four million values (years 1 to 9999),
    so their size is bounded whatever the tables, and the facts are not shuffled by date.
    """
    days = holidays.select(F.col("date").cast("date").alias(date)).distinct().withColumn(out, F.lit(1))
    joined = df.join(F.broadcast(days), date, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def holiday_table(spark, dates=HOLIDAYS) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "date string").select(F.col("date").cast("date"))


def scaled_time_features(time: Column) -> dict[str, Column]:
    """Eight calendar features, each scaled to [-0.5, 0.5]."""
    return {
        "second": F.second(time) / 59.0 - 0.5,
        "minute": F.minute(time) / 59.0 - 0.5,
        "hour": F.hour(time) / 23.0 - 0.5,
        "weekday": F.weekday(time) / 6.0 - 0.5,
        "day": (F.day(time) - 1) / 30.0 - 0.5,
        "dayofyear": (F.dayofyear(time) - 1) / 365.0 - 0.5,
        "month": (F.month(time) - 1) / 11.0 - 0.5,
        "week": (F.weekofyear(time) - 1) / 52.0 - 0.5,
    }


_DAILY = ("weekday", "day", "dayofyear")

# Features that suit each sampling frequency, finest first.
FREQUENCY_FEATURES = {
    "Y": (),
    "Q": ("month",),
    "M": ("month",),
    "W": ("day", "week"),
    "D": _DAILY,
    "B": _DAILY,
    "H": ("hour", *_DAILY),
    "T": ("minute", "hour", *_DAILY),
    "S": ("second", "minute", "hour", *_DAILY),
}

# Other spellings of the same frequencies.
FREQUENCY_ALIASES = {
    "A": "Y", "YE": "Y", "QE": "Q", "ME": "M", "MIN": "T",
}


def features_for(freq: str) -> tuple[str, ...]:
    """Feature names for a frequency such as ``H``, ``12H``, ``5min`` or ``W-SUN``."""
    unit = freq.strip().lstrip("0123456789").split("-")[0].upper()
    unit = FREQUENCY_ALIASES.get(unit, unit)
    if unit not in FREQUENCY_FEATURES:
        known = ", ".join(FREQUENCY_FEATURES)
        raise ValueError(f"unsupported frequency {freq!r}; use one of {known} (aliases A, min)")
    return FREQUENCY_FEATURES[unit]


def time_features(time: Column, freq: str = "H") -> dict[str, Column]:
    every = scaled_time_features(time)
    return {name: every[name] for name in features_for(freq)}


def time_marks(time: Column) -> dict[str, Column]:
    """Month, day, weekday and hour of a window step."""
    return {"month": F.month(time), "day": F.day(time), "weekday": F.weekday(time), "hour": F.hour(time)}


def days_per_month(dates: DataFrame, date: str = "date") -> DataFrame:
    """Days of each month of every calendar year touched by the dates."""
    years = dates.agg(F.min(F.year(date)).alias("a"), F.max(F.year(date)).alias("b"))
    span = F.sequence(F.make_date("a", F.lit(1), F.lit(1)), F.make_date("b", F.lit(12), F.lit(31)))
    days = years.select(F.explode(span).alias("d"))
    return days.groupBy(F.year("d").alias("year"), F.month("d").alias("month")).agg(F.count("*").alias("days"))
