"""Text cleaning for weather observations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trailing unit of each measured weather field.
WEATHER_UNITS = {
    "temperature": "F",
    "dew_point": "F",
    "humidity": "%",
    "wind_speed": "mph",
    "wind_gust": "mph",
    "pressure": "in",
    "precip": "in",
}


def strip_unit(text: Column, unit: str) -> Column:
    """``45 F`` to 45.0; text that is no number gives null."""
    return F.regexp_replace(text, f" *{re.escape(unit)} *$", "").try_cast("double")


def obs_time(date: Column, clock: Column) -> Column:
    """Date plus a clock text such as ``12:30 AM``; unreadable clocks give null."""
    pattern = r"^\s*(\d{1,2}):(\d{2})\s*([AaPp])[Mm]\s*$"
    hour = F.regexp_extract(clock, pattern, 1).try_cast("int") % 12
    minute = F.regexp_extract(clock, pattern, 2).try_cast("int")
    afternoon = F.lower(F.regexp_extract(clock, pattern, 3)) == "p"
    zero = F.lit(0)
    span = F.make_dt_interval(zero, hour + F.when(afternoon, 12).otherwise(0), minute)
    return date.cast("date").cast("timestamp_ntz") + span


def url_date(date: Column) -> Column:
    """Date as year-month-day without padding."""
    day = date.cast("date")
    return F.concat_ws("-", F.year(day), F.month(day), F.day(day))


def url_base(url: Column) -> Column:
    """Everything up to ``/date`` of a daily history address; other addresses stay as they are."""
    return F.regexp_replace(url, r"^(https://[^/]+/history/daily/.+/date)/.+$", "$1")
