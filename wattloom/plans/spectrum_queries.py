"""Circular correlation, strongest lags and delayed aggregation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wattloom.operators.spectrum import autocorrelation, delay_aggregate, lag_correlation, top_count, top_lags
from wattloom.operators.windows import gather
from wattloom.plans.inputs import (
    HOURLY_SPLIT_SQL, HOURLY_TOTAL_SQL, SEGMENT_TOTAL_SQL, hourly_split, hourly_totals, readings)
from wattloom.plans.registry import query, rounded
from wattloom.session import cut_lineage

LENGTH = 192
TOP = top_count(LENGTH)

# windows of log totals per test base and segment, correlated with themselves
WINDOW_SQL = f"""
    w AS (SELECT clust_id, b.pos AS base_pos, s.pos - b.pos + {LENGTH - 1} AS i, ln(1 + value) AS v
          FROM test b JOIN series s ON s.pos BETWEEN b.pos - {LENGTH - 1} AND b.pos),
    corr AS (SELECT x.clust_id, x.base_pos, ((x.i - y.i) + {LENGTH}) % {LENGTH} AS lag, sum(x.v * y.v) AS corr
             FROM w x JOIN w y ON x.clust_id = y.clust_id AND x.base_pos = y.base_pos GROUP BY 1, 2, 3)"""


def windows(spark, sf, by_segment: bool = True):
    rows = gather(hourly_totals(spark, sf, by_segment), hourly_split(spark, sf).test, LENGTH, 24)
    logs = rows.select("clust_id", "base_pos", F.transform("prev", lambda v: F.log1p(v)).alias("values"))
    return logs.withColumn("corr", autocorrelation(F.col("values"), F.col("values")))


@query("autocorr_lags", f"""
    WITH {HOURLY_TOTAL_SQL}, n AS (SELECT count(*) AS n FROM series)
    SELECT lag, round(sum(ln(1 + x.value) * ln(1 + y.value)), 6) AS corr
    FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM series) - 1)) AS lag), n, series y JOIN series x ON x.pos = (y.pos + lag) % n GROUP BY 1""")
def autocorr_lags(spark, sf):
    totals = hourly_totals(spark, sf)
    length = totals.agg(F.count("*").alias("n")).scalar()
    series = totals.select(F.col("clust_id").alias("series_id"), "pos", F.log1p("value").alias("a"), F.log1p("value").alias("b"))
    return rounded(lag_correlation(series, totals.count() - 1, length), 6, "corr").select("lag", "corr")


@query("autocorr_minutes", """
    WITH readings AS (SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS step, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1),
    ends AS (SELECT min(step) AS lo, max(step) - min(step) + 1 AS n FROM readings),
    s AS (SELECT step - lo AS pos, value, n FROM readings, ends),
    sums AS (SELECT (x.pos - y.pos + x.n) % x.n AS lag, sum(x.value * y.value) AS corr FROM s x, s y GROUP BY 1)
    SELECT lag, round(coalesce(corr, 0), 4) AS corr FROM (SELECT unnest(range(n)) AS lag FROM ends) LEFT JOIN sums USING (lag)""")
def autocorr_minutes(spark, sf):
    """All readings by the minute, a month long, against themselves at every lag."""
    minute = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / 60_000_000)
    sums = readings(spark, sf).groupBy(minute.alias("step")).agg(F.sum("value").cast("double").alias("a"))
    low, high = sums.agg(F.min("step"), F.max("step")).first()
    series = sums.select(F.lit(0).alias("series_id"), (F.col("step") - low).alias("pos"), "a", F.col("a").alias("b"))
    # cents times cents have four places; what rounds to zero has no sign
    return lag_correlation(series, high - low, F.lit(high - low + 1)).select("lag", (F.round("corr", 4) + F.lit(0.0)).alias("corr"))


@query("window_autocorr", f"""
    WITH {SEGMENT_TOTAL_SQL}, {HOURLY_SPLIT_SQL}, {WINDOW_SQL} SELECT clust_id, base_pos, lag, round(corr, 6) AS corr FROM corr""")
def window_autocorr(spark, sf):
    rows = windows(spark, sf).select("clust_id", "base_pos", F.posexplode("corr").alias("lag", "corr"))
    return rounded(rows, 6, "corr")


def top_sql(keys: str) -> str:
    return f"""
    top AS (SELECT * FROM (SELECT {keys}, lag, corr, row_number() OVER (PARTITION BY {keys} ORDER BY round(corr, 6) DESC, lag) AS rn FROM c)
            WHERE rn <= {TOP}),
    wt AS (SELECT {keys}, lag, exp(corr - max(corr) OVER (PARTITION BY {keys})) AS e FROM top),
    wn AS (SELECT {keys}, lag, e / sum(e) OVER (PARTITION BY {keys}) AS weight FROM wt)"""


@query("top_lags", f"""
    WITH {SEGMENT_TOTAL_SQL}, {HOURLY_SPLIT_SQL}, {WINDOW_SQL}, c AS (SELECT * FROM corr), {top_sql("clust_id, base_pos")}
    SELECT clust_id, base_pos, rn AS rank, lag, round(corr, 6) AS corr FROM top""")
def strongest_lags(spark, sf):
    best = windows(spark, sf).select("clust_id", "base_pos", F.posexplode(top_lags(F.col("corr"), TOP)).alias("_i", "_l"))
    return best.select("clust_id", "base_pos", (F.col("_i") + 1).alias("rank"), "_l.lag", F.round("_l.corr", 6).alias("corr"))


def delayed_sql(weights: str, keys: str) -> str:
    on = " AND ".join(f"w.{k.strip()} = wn.{k.strip()}" for k in keys.split(","))
    return f"""
    WITH {SEGMENT_TOTAL_SQL}, {HOURLY_SPLIT_SQL}, {WINDOW_SQL}, {weights}
    SELECT w.clust_id, w.base_pos, (w.i - wn.lag + {LENGTH}) % {LENGTH} AS step, round(sum(w.v * wn.weight), 6) AS value
    FROM w JOIN wn ON {on} GROUP BY 1, 2, 3"""


MEAN_SQL = "c AS (SELECT base_pos, lag, avg(corr) AS corr FROM corr GROUP BY 1, 2)"

DELAY_SQL = {
    "channel": delayed_sql(f"c AS (SELECT * FROM corr), {top_sql('clust_id, base_pos')}", "clust_id, base_pos"),
    "series": delayed_sql(f"{MEAN_SQL}, {top_sql('base_pos')}", "base_pos"),
    "batch": delayed_sql(f"""
    {MEAN_SQL}, shared AS (SELECT lag FROM (SELECT lag, row_number() OVER (ORDER BY round(avg(corr), 6) DESC, lag) AS rn FROM c GROUP BY lag) WHERE rn <= {TOP}),
    wt AS (SELECT base_pos, lag, exp(corr - max(corr) OVER (PARTITION BY base_pos)) AS e FROM c JOIN shared USING (lag)),
    wn AS (SELECT base_pos, lag, e / sum(e) OVER (PARTITION BY base_pos) AS weight FROM wt)""", "base_pos"),
}


def _delayed(scope: str):
    def run(spark, sf):
        rows = delay_aggregate(cut_lineage(windows(spark, sf)), LENGTH, scope)
        steps = rows.select("clust_id", "base_pos", F.posexplode("delayed").alias("step", "value"))
        return rounded(steps, 6, "value")

    return run


for _scope, _sql in DELAY_SQL.items():
    query(f"delay_aggregate_{_scope}", _sql)(_delayed(_scope))
