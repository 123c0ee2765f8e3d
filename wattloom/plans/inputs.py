"""Series that the queries share, and the SQL of the same series.

Meters are the users of ``events`` (hourly, one month) or ``orders`` as a whole (daily, several years).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.conf import ForecastConf
from wattloom.operators.series import cluster_totals, grid_index, regular_series
from wattloom.operators.split import Split
from wattloom.plans.registry import table

HOUR, DAY = 3600, 86400
# Eight bytes with six decimals: sums are exact and no digit of the readings is lost.
MONEY = "decimal(18,6)"

HOURLY = ForecastConf(season="winter")
DAILY = {s: ForecastConf(season=s, prev_times=28, next_times=7) for s in ("summer", "winter")}

EVENT_READINGS = "SELECT user_id AS meter_id, ts AS time, value FROM events"
ORDER_READINGS = "SELECT 0 AS meter_id, o_orderdate AS time, o_totalprice AS value FROM orders"


def readings(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return events.select("event_id", F.col("user_id").alias("meter_id"), F.col("ts").alias("time"),
                         F.col("value").cast(MONEY).alias("value"), "event_type")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Customer segment of each meter as its cluster."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("meter_id"), F.col("c_mktsegment").alias("clust_id"))


def hourly_series(spark: SparkSession, sf: str) -> DataFrame:
    return regular_series(readings(spark, sf).select("meter_id", "time", "value"), step_seconds=HOUR)


def hourly_totals(spark: SparkSession, sf: str, by_segment: bool = False) -> DataFrame:
    return cluster_totals(hourly_series(spark, sf), segments(spark, sf) if by_segment else None)


def hourly_split(spark: SparkSession, sf: str) -> Split:
    return Split(grid_index(readings(spark, sf), step_seconds=HOUR), HOURLY)


def order_readings(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.select(F.lit(0).alias("meter_id"), F.col("o_orderdate").alias("time"),
                         F.col("o_totalprice").cast(MONEY).alias("value"))


def daily_series(spark: SparkSession, sf: str) -> DataFrame:
    series = regular_series(order_readings(spark, sf), step_seconds=DAY)
    return series.withColumnRenamed("meter_id", "clust_id")


def daily_index(spark: SparkSession, sf: str) -> DataFrame:
    return grid_index(order_readings(spark, sf), step_seconds=DAY)


def daily_split(spark: SparkSession, sf: str, season: str) -> Split:
    return Split(daily_index(spark, sf), DAILY[season])


def filled_sql(source: str, step: int) -> str:
    """Tables ``bounds`` and ``filled`` (meter_id, pos, time, value) as the body of a WITH clause."""
    return f"""
    readings AS ({source}),
    steps AS (
      SELECT meter_id, CAST(floor(epoch(time) / {step}) AS BIGINT) AS step,
             CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
      FROM readings GROUP BY 1, 2),
    bounds AS (SELECT min(step) AS lo, max(step) AS hi FROM steps),
    grid AS (
      SELECT m.meter_id, g.step
      FROM (SELECT DISTINCT meter_id FROM steps) m,
           (SELECT unnest(generate_series(lo, hi)) AS step FROM bounds) g),
    aligned AS (SELECT meter_id, step, value FROM grid LEFT JOIN steps USING (meter_id, step)),
    near AS (
      SELECT meter_id, step, value,
             last_value(value IGNORE NULLS) OVER back AS v0,
             last_value(CASE WHEN value IS NOT NULL THEN step END IGNORE NULLS) OVER back AS s0,
             first_value(value IGNORE NULLS) OVER ahead AS v1,
             first_value(CASE WHEN value IS NOT NULL THEN step END IGNORE NULLS) OVER ahead AS s1
      FROM aligned
      WINDOW back AS (PARTITION BY meter_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             ahead AS (PARTITION BY meter_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (
      SELECT meter_id, step - (SELECT lo FROM bounds) AS pos, make_timestamp(step * {step} * 1000000) AS time,
             CASE WHEN s0 = step THEN value WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0
                  ELSE v0 + (v1 - v0) * (step - s0) / (s1 - s0) END AS value
      FROM near)"""


HOURLY_SQL = filled_sql(EVENT_READINGS, HOUR)
DAILY_SQL = filled_sql(ORDER_READINGS, DAY)

HOURLY_TOTAL_SQL = HOURLY_SQL + """,
    series AS (SELECT 0 AS clust_id, pos, time, SUM(value) AS value FROM filled GROUP BY pos, time)"""

SEGMENT_TOTAL_SQL = HOURLY_SQL + """,
    series AS (
      SELECT c_mktsegment AS clust_id, pos, time, SUM(value) AS value
      FROM filled JOIN customer ON c_custkey = meter_id GROUP BY 1, 2, 3)"""

DAILY_TOTAL_SQL = DAILY_SQL + """,
    series AS (SELECT meter_id AS clust_id, pos, time, value FROM filled)"""


def split_sql(conf: ForecastConf) -> str:
    """Tables ``season``, ``bases``, ``start``, ``train`` and ``test`` over a table ``series``."""
    months = ", ".join(str(m) for m in conf.summer_months)
    negate = "" if conf.season == "summer" else "NOT "
    return f"""
    idx AS (SELECT DISTINCT pos, time FROM series),
    season AS (SELECT pos, time FROM idx WHERE month(time) {negate}IN ({months})),
    bases AS (
      SELECT pos, time FROM season
      WHERE pos - {conf.prev_times} IN (SELECT pos FROM season) AND pos + {conf.next_times} IN (SELECT pos FROM season)),
    start AS (
      SELECT min(pos) AS test_start FROM (SELECT pos, time, percent_rank() OVER (ORDER BY pos) AS q FROM bases)
      WHERE q > 1 - {conf.test_ratio} AND hour(time) = 0 AND minute(time) = 0),
    train AS (SELECT pos FROM bases WHERE pos < (SELECT test_start FROM start)),
    test AS (
      SELECT pos FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS rn FROM bases
                       WHERE pos >= (SELECT test_start FROM start) - 1)
      WHERE rn % {conf.next_times} = 0)"""


HOURLY_SPLIT_SQL = split_sql(HOURLY)
