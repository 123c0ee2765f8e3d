"""Calendar features, holidays and weather."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wattloom.functions.calendar import (
    calendar_features, days_per_month, holiday_flag, time_features, time_marks, weekday_flags)
from wattloom.functions.text import url_base, url_date
from wattloom.operators.climate import clean_observations, day_rollover
from wattloom.operators.joins import beside, join_climate
from wattloom.operators.ordered import even_block
from wattloom.operators.series import grid_index
from wattloom.plans.inputs import (
    DAILY_TOTAL_SQL, HOURLY_TOTAL_SQL, daily_index, daily_series, hourly_totals, readings)
from wattloom.plans.registry import query, rounded, table, text_time
from wattloom.sources.pages import WEATHER_HEADER, html_cells

CYCLES = {
    "minute": "minute(time) / 60.0",
    "hour": "(hour(time) + minute(time) / 60.0) / 24.0",
    "day": "day(time) / CAST(day(last_day(time)) AS DOUBLE)",
    "month": "month(time) / 12.0",
}
FLAGS = ("mon_yn", "tue_yn", "wed_yn", "thu_yn", "fri_yn", "sat_yn")

CYCLE_SQL = ", ".join(
    f"round(sin({2 * math.pi!r} * ({e})), 9) AS {n}_x, round(cos({2 * math.pi!r} * ({e})), 9) AS {n}_y" for n, e in CYCLES.items())
FLAG_SQL = ", ".join(f"CAST(isodow(time) = {k} AS INTEGER) AS {n}" for k, n in enumerate(FLAGS, 1))
CYCLE_NAMES = [f"{n}_{a}" for n in CYCLES for a in "xy"]

HALF_HOURS_SQL = """
    idx AS (SELECT unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, min(ts)), max(ts), INTERVAL 30 MINUTE)) AS time FROM events)"""
DAYS_SQL = """
    idx AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS time FROM orders)"""


@query("calendar_features", f"""
    WITH {HALF_HOURS_SQL} SELECT CAST(time AS VARCHAR) AS time, CAST(CAST(time AS DATE) AS VARCHAR) AS date, {CYCLE_SQL}, {FLAG_SQL} FROM idx""")
def half_hour_calendar(spark, sf):
    rows = calendar_features(grid_index(readings(spark, sf), step_seconds=1800).select("time"))
    return text_time(rounded(rows, 9, *CYCLE_NAMES), "time", "date")


@query("calendar_features_days", f"""
    WITH {DAYS_SQL} SELECT CAST(time AS VARCHAR) AS time, CAST(CAST(time AS DATE) AS VARCHAR) AS date, {CYCLE_SQL}, {FLAG_SQL} FROM idx""")
def day_calendar(spark, sf):
    rows = calendar_features(daily_index(spark, sf).select("time"))
    return text_time(rounded(rows, 9, *CYCLE_NAMES), "time", "date")


@query("weekday_flags", f"SELECT o_orderkey, {FLAG_SQL} FROM (SELECT o_orderkey, o_orderdate AS time FROM orders)")
def order_weekdays(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in weekday_flags(F.col("o_orderdate")).items()])


@query("holiday_flags", """
    SELECT o_orderkey, CAST(o_orderdate IN (
      SELECT l_shipdate FROM lineitem WHERE strftime(l_shipdate, '%m-%d') IN ('01-01', '03-17', '12-24', '12-25', '12-26', '12-31')
    ) AS INTEGER) AS holiday_yn FROM orders""")
def order_holidays(spark, sf):
    shipped = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    holidays = shipped.where(F.date_format("date", "MM-dd").isin("01-01", "03-17", "12-24", "12-25", "12-26", "12-31"))
    days = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return holiday_flag(days, holidays).select("o_orderkey", "holiday_yn")


SCALED = {
    "second": "second(ts) / 59.0 - 0.5",
    "minute": "minute(ts) / 59.0 - 0.5",
    "hour": "hour(ts) / 23.0 - 0.5",
    "weekday": "(isodow(ts) - 1) / 6.0 - 0.5",
    "day": "(day(ts) - 1) / 30.0 - 0.5",
    "dayofyear": "(dayofyear(ts) - 1) / 365.0 - 0.5",
    "month": "(month(ts) - 1) / 11.0 - 0.5",
    "week": "(weekofyear(ts) - 1) / 52.0 - 0.5",
}
BY_FREQUENCY = {
    "m": ("month",),
    "w": ("day", "week"),
    "d": ("weekday", "day", "dayofyear"),
    "h": ("hour", "weekday", "day", "dayofyear"),
    "t": ("minute", "hour", "weekday", "day", "dayofyear"),
    "s": ("second", "minute", "hour", "weekday", "day", "dayofyear"),
}


def _scaled(freq: str):
    def run(spark, sf):
        source = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts")) \
            if freq in "mwd" else table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
        features = time_features(F.col("ts"), freq.upper())
        return source.select("id", *[F.round(c, 9).alias(n) for n, c in features.items()])

    return run


for _freq, _names in BY_FREQUENCY.items():
    _from = "SELECT o_orderkey AS id, o_orderdate AS ts FROM orders" if _freq in "mwd" else "SELECT event_id AS id, ts FROM events"
    _cols = ", ".join(f"round({SCALED[n]}, 9) AS {n}" for n in _names)
    query(f"scaled_time_features_{_freq}", f"SELECT id, {_cols} FROM ({_from})")(_scaled(_freq))


@query("time_marks", """
    SELECT event_id, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS weekday, hour(ts) AS hour FROM events""")
def event_marks(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in time_marks(F.col("ts")).items()])


@query("days_per_month", """
    SELECT year(d) AS year, month(d) AS month, count(*) AS days FROM (
      SELECT unnest(generate_series(make_timestamp(min(year(o_orderdate)), 1, 1, 0, 0, 0),
                                    make_timestamp(max(year(o_orderdate)), 12, 31, 0, 0, 0), INTERVAL 1 DAY)) AS d FROM orders)
    GROUP BY 1, 2""")
def month_lengths(spark, sf):
    return days_per_month(table(spark, sf, "orders"), "o_orderdate")


def weather_text(spark, sf):
    """Weather table cells written from events; error events have unreadable numbers."""
    events = table(spark, sf, "events")
    number = F.when(F.col("event_type") == "error", "--").otherwise(F.col("value").cast("string"))
    units = {"Temperature": " F", "Dew Point": "  F ", "Humidity": " %", "Wind Speed": " mph", "Wind Gust": "mph",
             "Pressure": " in", "Precip.": " in"}
    cells = {"Time": F.date_format("ts", "h:mm a"), "Wind": F.upper(F.substring("event_type", 1, 2)), "Condition": F.col("event_type")}
    cells.update({n: F.concat(number, F.lit(u)) for n, u in units.items()})
    return events.select("event_id", F.col("ts").cast("date").alias("date"), *[cells[n].alias(n) for n in WEATHER_HEADER])


MEASURE_SQL = ", ".join(
    f"CASE WHEN event_type <> 'error' THEN value END AS {n}"
    for n in ("temperature", "dew_point", "humidity", "wind_speed", "wind_gust", "pressure", "precip"))


@query("clean_observations", f"""
    SELECT event_id, CAST(date_trunc('minute', ts) AS VARCHAR) AS time, {MEASURE_SQL},
           upper(substr(event_type, 1, 2)) AS wind, event_type AS condition FROM events""")
def cleaned(spark, sf):
    return text_time(clean_observations(weather_text(spark, sf)).drop("date"), "time")


HTML_NAMES = {n: n.lower().replace(" ", "_").replace(".", "") for n in WEATHER_HEADER}


@query("html_cells", """
    SELECT event_id, 1 AS row, strftime(ts, '%-I:%M %p') AS time, value || ' F' AS temperature, '<' || event_type || '> & more' AS condition,
           'A B' AS wind FROM events""")
def page_cells(spark, sf):
    events = table(spark, sf, "events")
    own = {"Time": F.date_format("ts", "h:mm a"), "Temperature": F.concat(F.lit("<span>"), F.col("value").cast("string"), F.lit("</span>&nbsp;<span>F</span>")),
           "Condition": F.concat(F.lit("&lt;"), F.col("event_type"), F.lit("&gt; &amp; more")), "Wind": F.lit(" A\n  B ")}
    head = F.concat(*[F.lit(f"<th scope='col'>{n}</th>") for n in reversed(WEATHER_HEADER)])
    body = F.concat(*[F.concat(F.lit("<td class='c'>"), own.get(n, F.lit("-")), F.lit("</TD >")) for n in reversed(WEATHER_HEADER)])
    other = F.lit("<table><tr><th>Menu</th><td>Time</td></tr></table>")
    title = F.when(F.col("event_id") % 2 == 0, F.lit("<tr><td>Observations</td></tr>")).otherwise(F.lit(""))
    pages = events.select("event_id", F.concat(other, F.lit("<table>"), title, F.lit("<tr>"), head, F.lit("</tr>\n<tr>"), body, F.lit("</tr></table>"), other).alias("html"))
    rows = html_cells(pages, "html").withColumnsRenamed(HTML_NAMES)
    return rows.select("event_id", "row", "time", "temperature", "condition", "wind")


@query("url_parts", """
    SELECT event_id, 'https://weather.example.org/history/daily/xx/s' || user_id || '/date' AS base,
           strftime(ts, '%Y-%-m-%-d') AS day FROM events""")
def url_parts(spark, sf):
    events = table(spark, sf, "events").withColumn("day", url_date(F.col("ts")))
    url = F.concat(F.lit("https://weather.example.org/history/daily/xx/s"), F.col("user_id").cast("string"), F.lit("/date/"), "day")
    return events.select("event_id", url_base(url).alias("base"), "day")


@query("day_rollover", """
    WITH c AS (SELECT event_id, user_id, TIMESTAMP '2009-06-01' + to_minutes(CAST(hour(ts) * 60 + minute(ts) AS BIGINT)) AS time FROM events),
    d AS (SELECT *, CASE WHEN time < lag(time) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS dropped FROM c),
    g AS (SELECT *, CAST(sum(dropped) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM d),
    n AS (SELECT user_id, grp, count(*) AS cnt FROM g GROUP BY 1, 2),
    m AS (SELECT user_id, grp AS major FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, grp) AS rn FROM n) WHERE rn = 1)
    SELECT event_id, user_id, grp AS day_group,
           CAST(CASE WHEN grp > major THEN time + INTERVAL 1 DAY WHEN grp < major THEN time - INTERVAL 1 DAY ELSE time END AS VARCHAR) AS time
    FROM g JOIN m USING (user_id)""")
def rolled_days(spark, sf):
    events = table(spark, sf, "events")
    clock = F.lit("2009-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour("ts"), F.minute("ts"))
    obs = events.select("event_id", "user_id", clock.alias("time"))
    placed = day_rollover(obs, ["user_id"], "event_id", block=even_block(obs, "event_id"))
    return text_time(placed.select("event_id", "user_id", "day_group", "time"), "time")


@query("climate_join", f"""
    WITH {DAYS_SQL} SELECT CAST(time AS VARCHAR) AS time, temp_max, temp_min FROM idx
    LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS d, max(l_extendedprice) AS temp_max, min(l_extendedprice) AS temp_min FROM lineitem GROUP BY 1)
    ON d = CAST(time AS DATE)""")
def climate_days(spark, sf):
    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    climate = shipped.agg(F.max("l_extendedprice").alias("temp_max"), F.min("l_extendedprice").alias("temp_min"))
    calendar = daily_index(spark, sf).select("time", F.col("time").cast("date").alias("date"))
    return text_time(join_climate(calendar, climate).drop("date"), "time")


@query("master_rows", f"""
    WITH {HOURLY_TOTAL_SQL} SELECT CAST(time AS VARCHAR) AS time, round(value, 6) AS value, {CYCLE_SQL}, {FLAG_SQL} FROM series""")
def master_rows(spark, sf):
    totals = hourly_totals(spark, sf).select("time", "value")
    calendar = calendar_features(grid_index(readings(spark, sf)).select("time")).drop("date")
    rows = beside(calendar, totals)
    return text_time(rounded(rounded(rows, 9, *CYCLE_NAMES), 6, "value"), "time")
