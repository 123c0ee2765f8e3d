"""From raw files to the tables the models read: meter series, calendar and weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.calendar import calendar_features, holiday_flag, holiday_table
from wattloom.functions.timecode import TICK_MINUTES, decode_code, off_grid, step_index, step_time, time_grid
from wattloom.operators.climate import clean_observations, day_rollover
from wattloom.operators.joins import join_climate
from wattloom.operators.series import fill_gaps, first_per_key, to_hourly
from wattloom.sources.pages import html_cells
from wattloom.sources.tables import append_missing, only_missing, write_table

STEP = TICK_MINUTES * 60


def meter_series(readings: DataFrame, allocations: DataFrame, codes: Sequence[str] = ("1", "2"),
                 order: Sequence[str] = ("value",)) -> DataFrame:
    """Half-hour series of all meters of the given classes: meter_id, pos, time, value.

    Of several readings with one code the first by ``order`` counts. Readings whose code is malformed or whose tick lies
    past the day match no grid step and are dropped (``dropped_readings`` counts them); a meter that has only such
    readings stays, without values. The grid runs over the codes that can be decoded.

    Copies are combined before anything is joined: then a meter has one row per code, and no key is hot.
    """
    meters = allocations.where(F.col("code").isin(*codes)).select("id").distinct()
    columns = ["id", "code", "value", *[c for c in order if c not in ("id", "code", "value")]]
    firsts = first_per_key(readings.select(*columns), ("id", "code"), order).join(meters, "id", "left_semi")
    sound = F.when(decode_code(F.col("code")).isNotNull(), F.col("code"))
    ranges = readings.groupBy("id").agg(F.min(sound).alias("a"), F.max(sound).alias("z")).join(meters, "id", "left_semi")
    lo = ranges.agg(step_index(decode_code(F.min("a")), STEP).alias("lo")).scalar()
    hi = ranges.agg(step_index(decode_code(F.max("z")), STEP).alias("hi")).scalar()
    placed = firsts.select(
        "id", step_index(decode_code(F.col("code")), STEP).alias("step"),
        F.when(~off_grid(F.col("code")), F.col("value").cast("double")).alias("value"))
    filled = fill_gaps(placed, "id", "step", "value", lo, hi)
    return filled.select(F.col("id").alias("meter_id"), (F.col("step") - lo).alias("pos"),
                         step_time(F.col("step"), STEP).alias("time"), "value")


def dropped_readings(readings: DataFrame) -> DataFrame:
    """Number of readings that match no grid step."""
    return readings.where(off_grid(F.col("code"))).agg(F.count("*").alias("dropped"))


def calendar_table(bounds: DataFrame, climate: DataFrame, holidays: DataFrame | None = None,
                   start: str = "start", end: str = "end") -> DataFrame:
    """Half-hour calendar between two times with weather of the day and holiday flag."""
    calendar = calendar_features(time_grid(bounds, start, end, STEP))
    dated = join_climate(calendar, climate)
    return holiday_flag(dated, holiday_table(bounds.sparkSession) if holidays is None else holidays)


def hourly_master(series: DataFrame) -> DataFrame:
    """Hourly series of every meter, with hourly grid positions.

    Every row knows where its grid starts (its step less its position), so the series is computed once.
    """
    start = F.floor((step_index(F.col("time"), STEP) - F.col("pos")) * STEP / 3600)
    hours = to_hourly(series.select("meter_id", "time", "value", start.alias("_start")), firsts=("_start",))
    return hours.select("meter_id", (step_index(F.col("time"), 3600) - F.col("_start")).alias("pos"), "time",
                        F.col("value").cast("double").alias("value"))


def write_series(series: DataFrame, path: str) -> None:
    """Parquet by month; the meters of a month share its files."""
    write_table(series.withColumn("month", F.date_format(F.col("time").cast("date"), "yyyy-MM")), path, ("month",))


def observations(pages: DataFrame, keys: Sequence[str] = ("station", "date"), html: str = "html") -> DataFrame:
    """Weather observations from stored daily pages, midnight corrected within each page."""
    cells = html_cells(pages.select(*keys, html), html)
    return day_rollover(clean_observations(cells), list(keys), "row").drop("day_group")


def load_missing_days(pages: DataFrame, path: str, keys: Sequence[str] = ("station", "date")) -> None:
    """Parse and append the days that are not in the table yet; pages of finished days are not parsed."""
    spark = pages.sparkSession
    try:
        pages = only_missing(pages, spark.read.parquet(path), keys)
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    append_missing(observations(pages, keys), path, list(keys))
