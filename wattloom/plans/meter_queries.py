"""Readings, codes, roll-up and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions.timecode import code_grid, date_list, decode_code, encode_code, floor_time
from wattloom.operators.joins import keep_allocated
from wattloom.operators.ordered import even_block, positions
from wattloom.operators.series import (
    code_range, day_lags, distinct_ids, first_per_key, first_steps, sample_meters, to_daily, to_hourly, to_long, to_wide)
from wattloom.plans.inputs import HOURLY_SQL, HOURLY_TOTAL_SQL, filled_sql, hourly_series, hourly_totals, readings
from wattloom.plans.master import dropped_readings, meter_series
from wattloom.plans.registry import query, rounded, table, text_time
from wattloom.sources.tables import only_missing, union_parts

# Fixed value: days from the first day of the code calendar to the first day of the events.
CODE_SHIFT = 5478

CODE_SQL = """
    lpad(CAST(date_diff('day', DATE '2009-01-01', CAST(ts - INTERVAL 5478 DAY AS DATE)) + 1 AS VARCHAR), 3, '0')
    || lpad(CAST(hour(ts) * 2 + minute(ts) // 30 + 1 AS VARCHAR), 2, '0')"""


def coded(spark, sf):
    """Readings with meter id and time code, moved into the code calendar."""
    at = F.col("time") - F.make_dt_interval(F.lit(CODE_SHIFT))
    return readings(spark, sf).select("event_id", F.col("meter_id").alias("id"), encode_code(at).alias("code"), "value")


@query("hourly_load", """
    SELECT user_id AS meter_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS time, arg_min(event_type, ts) AS first_type,
           CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM events GROUP BY 1, 2""")
def hourly_load(spark, sf):
    rows = readings(spark, sf).withColumnRenamed("event_type", "first_type")
    hours = to_hourly(rows, firsts=("first_type",))
    return text_time(hours.withColumn("value", F.col("value").cast("double")), "time")


@query("daily_load", """
    SELECT user_id AS meter_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
           CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM events GROUP BY 1, 2""")
def daily_load(spark, sf):
    days = to_daily(readings(spark, sf))
    return text_time(days.withColumn("value", F.col("value").cast("double")), "date")


@query("allocated_readings", f"""
    SELECT event_id, user_id AS id, {CODE_SQL} AS code, value FROM events
    WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD'))""")
def allocated_readings(spark, sf):
    allocations = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("code"))
    kept = keep_allocated(coded(spark, sf), allocations, ("BUILDING", "HOUSEHOLD"))
    return kept.withColumn("value", F.col("value").cast("double"))


@query("code_roundtrip", f"""
    SELECT event_id, {CODE_SQL} AS code,
           CAST(time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 5478 DAY AS VARCHAR) AS time FROM events""")
def code_roundtrip(spark, sf):
    return text_time(coded(spark, sf).select("event_id", "code", decode_code(F.col("code")).alias("time")), "time")


@query("code_range", f"SELECT min({CODE_SQL}) AS start_code, max({CODE_SQL}) AS end_code FROM events")
def code_bounds(spark, sf):
    return code_range(coded(spark, sf))


@query("distinct_meters", "SELECT DISTINCT user_id AS meter_id FROM events")
def distinct_meters(spark, sf):
    return distinct_ids(readings(spark, sf), "meter_id")


@query("first_reading_per_code", f"""
    SELECT user_id AS id, {CODE_SQL} AS code, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""")
def first_reading_per_code(spark, sf):
    rows = coded(spark, sf).withColumn("value", F.col("value").cast("double"))
    return first_per_key(rows, ("id", "code"), ("event_id",)).select("id", "code", "value")


@query("time_grid", f"""
    WITH b AS (SELECT time_bucket(INTERVAL 30 MINUTE, min(ts)) AS a, time_bucket(INTERVAL 30 MINUTE, max(ts)) AS z FROM events),
    g AS (SELECT unnest(generate_series(a, z, INTERVAL 30 MINUTE)) AS ts FROM b)
    SELECT CAST(ts - INTERVAL 5478 DAY AS VARCHAR) AS time, {CODE_SQL} AS code FROM g""")
def half_hour_grid(spark, sf):
    shift = F.make_dt_interval(F.lit(CODE_SHIFT))
    bounds = readings(spark, sf).agg(
        (floor_time(F.min("time"), 1800) - shift).alias("a"), (floor_time(F.max("time"), 1800) - shift).alias("z"))
    return text_time(code_grid(bounds, "a", "z"), "time")


@query("date_list", """
    SELECT CAST(CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS date
    FROM orders""")
def dates(spark, sf):
    bounds = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return text_time(date_list(bounds, "a", "z"), "date")


@query("missing_dates", """
    SELECT CAST(d AS VARCHAR) AS date FROM (
      SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)
    WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def missing_dates(spark, sf):
    orders = table(spark, sf, "orders")
    bounds = orders.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    done = orders.select(F.col("o_orderdate").cast("date").alias("date"))
    return text_time(only_missing(date_list(bounds, "a", "z"), done, "date"), "date")


@query("union_parts", """
    SELECT event_id, event_type, value, CASE WHEN event_type = 'error' THEN props END AS note FROM events""")
def stacked_parts(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    noted = F.col("event_type").eqNullSafe("error")
    return union_parts([events.where(noted).withColumnRenamed("props", "note"), events.where(~noted).drop("props")])


@query("reading_positions", """
    SELECT event_id, user_id AS meter_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events""")
def reading_positions(spark, sf):
    rows = readings(spark, sf).select("event_id", "meter_id")
    return positions(rows, ["meter_id"], ["event_id"], even_block(rows, "event_id"))


@query("filled_series", f"WITH {HOURLY_SQL} SELECT meter_id, pos, CAST(time AS VARCHAR) AS time, value FROM filled")
def filled_series(spark, sf):
    return text_time(hourly_series(spark, sf), "time")


@query("day_lags", f"""
    WITH {HOURLY_SQL} SELECT meter_id, pos, value,
      {", ".join(f"lag(value, {24 * k}) OVER w AS value_d{k}_t_" for k in range(1, 8))}
    FROM filled WINDOW w AS (PARTITION BY meter_id ORDER BY pos)""")
def lagged_days(spark, sf):
    return day_lags(hourly_series(spark, sf), ("value",)).drop("time")


@query("unpivot_types", """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'h' || event_type AS meter_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM events GROUP BY 1, 2""")
def unpivot_types(spark, sf):
    rows = readings(spark, sf).withColumn("meter_id", F.col("event_type"))
    days = to_daily(rows).withColumn("value", F.col("value").cast("double"))
    types = [r["event_type"] for r in table(spark, sf, "events").select("event_type").distinct().dropna().orderBy("event_type").collect()]
    wide = to_wide(days, types, ("date",))
    return text_time(to_long(wide, [f"h{t}" for t in types], ("date",)).dropna(), "date")


@query("first_300", f"""
    WITH {HOURLY_TOTAL_SQL} SELECT pos, CAST(time AS VARCHAR) AS time, round(value, 6) AS value
    FROM series ORDER BY series.time LIMIT 300""")
def first_hours(spark, sf):
    head = first_steps(hourly_totals(spark, sf), 300)
    return text_time(rounded(head.select("pos", "time", "value"), 6, "value"), "time")


@query("sample_meters", """
    SELECT user_id AS meter_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
    FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY md5(user_id || ':0'), user_id LIMIT 40) GROUP BY 1, 2""")
def sampled_meters(spark, sf):
    days = to_daily(readings(spark, sf))
    return text_time(sample_meters(days.withColumn("value", F.col("value").cast("double")), 40), "date")


# half-hour series of the meters of two segments, first reading per code
MASTER_SOURCE = """
    SELECT user_id AS meter_id, time_bucket(INTERVAL 30 MINUTE, ts) AS time, arg_min(value, event_id) AS value FROM events
    WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')) GROUP BY 1, 2"""


@query("master_series", f"""
    WITH {filled_sql(MASTER_SOURCE, 1800)} SELECT meter_id, pos, CAST(time - INTERVAL 5478 DAY AS VARCHAR) AS time, value FROM filled""")
def master_series(spark, sf):
    allocations = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("code"))
    rows = coded(spark, sf).withColumn("value", F.col("value").cast("double"))
    return text_time(meter_series(rows, allocations, ("BUILDING", "HOUSEHOLD"), ("event_id",)), "time")


# Every 97th code is no code; every 89th, but for the last day, has a tick past the day.
BAD_SQL = "event_id % 97 = 0 OR event_id % 89 = 0 AND ts < TIMESTAMP '2024-01-30'"


def badly_coded(spark, sf):
    day = F.substring("code", 1, 3)
    late = (F.col("event_id") % 89 == 0) & (day < "030")
    code = F.when(F.col("event_id") % 97 == 0, "xx").when(late, F.concat(day, F.lit("49"))).otherwise(F.col("code"))
    return coded(spark, sf).withColumns({"code": code, "value": F.col("value").cast("double")})


@query("dropped_readings", f"SELECT count(*) AS dropped FROM events WHERE {BAD_SQL}")
def dropped(spark, sf):
    return dropped_readings(badly_coded(spark, sf))


@query("bad_code_series", "WITH " + filled_sql("""
    SELECT user_id AS meter_id, time_bucket(INTERVAL 30 MINUTE, min(ts)) - INTERVAL 5478 DAY AS time, arg_min(value, event_id) AS value
    FROM events WHERE NOT (""" + BAD_SQL + """) GROUP BY user_id, time_bucket(INTERVAL 30 MINUTE, ts)""", 1800) + """
    SELECT meter_id, pos, CAST(time AS VARCHAR) AS time, value FROM filled""")
def series_with_bad_codes(spark, sf):
    rows = badly_coded(spark, sf)
    return text_time(meter_series(rows, rows.select("id").distinct().withColumn("code", F.lit("1")), order=("event_id",)), "time")
