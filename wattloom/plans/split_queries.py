"""Season, split, targets, windows, lags and trend."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wattloom.functions.calendar import time_marks
from wattloom.operators.forecast import window_samples
from wattloom.operators.series import cluster_totals, decompose, seasonal_lags
from wattloom.operators.split import Split, except_positions, intersect_positions, season_gaps, season_index
from wattloom.operators.windows import array_sum, decoder_seed, gather, gather_steps, horizon_targets, sequence_window
from wattloom.plans.inputs import (
    DAILY, DAILY_TOTAL_SQL, HOURLY, HOURLY_SPLIT_SQL, HOURLY_TOTAL_SQL, SEGMENT_TOTAL_SQL, daily_index, daily_series,
    daily_split, hourly_split, hourly_totals, segments, hourly_series, split_sql)
from wattloom.plans.registry import query, rounded, text_time

LABEL_LEN, KERNEL = 12, 11


def both_seasons(run):
    """Run a query for each season and stack the results with a season column."""
    parts = [run(season).withColumn("season", F.lit(season)) for season in DAILY]
    return parts[0].unionByName(parts[1])


def season_sql(select: str) -> str:
    parts = [f"SELECT '{s}' AS season, * FROM (WITH {DAILY_TOTAL_SQL}, {split_sql(c)} {select})" for s, c in DAILY.items()]
    return " UNION ALL ".join(parts)


def weighted(values):
    """Sum of position times value: equal only if the values are in the same order."""
    return array_sum(F.transform(values, lambda v, i: v * (i + 1)))


@query("season_bases", season_sql("SELECT pos, CAST(time AS VARCHAR) AS time FROM bases"))
def season_bases(spark, sf):
    return text_time(both_seasons(lambda s: daily_split(spark, sf, s).bases), "time")


@query("season_gaps", season_sql(
    "SELECT pos, gap FROM (SELECT pos, pos - lag(pos) OVER (ORDER BY pos) AS gap FROM season) WHERE gap > 1"))
def gaps(spark, sf):
    return both_seasons(lambda s: season_gaps(season_index(daily_index(spark, sf), DAILY[s])))


@query("split_point", season_sql("SELECT test_start FROM start"))
def split_points(spark, sf):
    return both_seasons(lambda s: daily_split(spark, sf, s).start)


@query("split_roles", season_sql("""
    SELECT pos, CASE WHEN pos < (SELECT test_start FROM start) THEN 'train' ELSE 'test' END AS role FROM season"""))
def roles(spark, sf):
    return both_seasons(lambda s: daily_split(spark, sf, s).roles.select("pos", "role"))


@query("test_bases", season_sql("SELECT pos FROM test"))
def chosen_test_bases(spark, sf):
    return both_seasons(lambda s: daily_split(spark, sf, s).test.select("pos"))


@query("train_bases", season_sql("SELECT pos, pos + 7 < (SELECT test_start FROM start) AS purged_too FROM train"))
def chosen_train_bases(spark, sf):
    def run(season):
        split = daily_split(spark, sf, season)
        return split.train.select("pos", (F.col("pos") + 7 < split.start.scalar()).alias("purged_too"))

    return both_seasons(run)


@query("position_sets", season_sql("""
    SELECT pos, 'in both' AS part FROM bases WHERE pos IN (SELECT pos FROM test)
    UNION ALL SELECT pos, 'base only' AS part FROM bases WHERE pos NOT IN (SELECT pos FROM test)"""))
def position_sets(spark, sf):
    def run(season):
        split = daily_split(spark, sf, season)
        both = intersect_positions(split.bases, split.test).select("pos", F.lit("in both").alias("part"))
        return both.unionByName(except_positions(split.bases, split.test).select("pos", F.lit("base only").alias("part")))

    return both_seasons(run)


def bootstrap_sql(seed: int) -> str:
    return f"""
    SELECT {seed} AS seed, pos FROM (WITH {DAILY_TOTAL_SQL}, {split_sql(DAILY["summer"])},
    ranked AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS rn FROM train),
    draws AS (SELECT CAST('0x' || substr(md5(i || ':{seed}'), 1, 15) AS BIGINT) % (SELECT count(*) FROM train) AS rn
              FROM (SELECT unnest(generate_series(0, (SELECT count(*) // 2 FROM bases) - 1)) AS i))
    SELECT pos FROM draws JOIN ranked USING (rn))"""


@query("bootstrap_bases", f"{bootstrap_sql(0)} UNION ALL {bootstrap_sql(1)}")
def bootstrap(spark, sf):
    conf = replace(DAILY["summer"], train_sample_ratio=0.5)
    parts = [Split(daily_index(spark, sf), conf, seed=s).training_sample().select(F.lit(s).alias("seed"), "pos") for s in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("horizon_targets", f"""
    WITH {HOURLY_TOTAL_SQL}, {HOURLY_SPLIT_SQL}
    SELECT clust_id, b.pos AS base_pos, h AS horizon, s.pos AS pos, round(s.value, 6) AS target
    FROM bases b, (SELECT unnest(generate_series(1, 24)) AS h) JOIN series s ON s.pos = b.pos + h""")
def targets(spark, sf):
    split = hourly_split(spark, sf)
    return rounded(horizon_targets(hourly_totals(spark, sf), split.bases, HOURLY.next_times), 6, "target")


CHECKS = ("prev_sum", "prev_weighted", "next_sum", "next_weighted")


def checked(df, prev: str, ahead: str):
    logs = df.withColumns({c: F.transform(c, lambda v: F.log1p(v)) for c in (prev, ahead)})
    sums = {"prev_sum": array_sum(F.col(prev)), "prev_weighted": weighted(F.col(prev)),
            "next_sum": array_sum(F.col(ahead)), "next_weighted": weighted(F.col(ahead))}
    return logs.withColumns({n: F.round(c, 6) for n, c in sums.items()}).drop(prev, ahead)


def window_sql(bases: str) -> str:
    return f"""
    SELECT clust_id, b.pos AS base_pos,
           round(sum(CASE WHEN s.pos <= b.pos THEN ln(1 + value) END), 6) AS prev_sum,
           round(sum(CASE WHEN s.pos <= b.pos THEN ln(1 + value) * (s.pos - b.pos + 192) END), 6) AS prev_weighted,
           round(sum(CASE WHEN s.pos > b.pos THEN ln(1 + value) END), 6) AS next_sum,
           round(sum(CASE WHEN s.pos > b.pos THEN ln(1 + value) * (s.pos - b.pos) END), 6) AS next_weighted
    FROM {bases} b JOIN series s ON s.pos BETWEEN b.pos - 191 AND b.pos + 24 GROUP BY 1, 2"""


@query("window_arrays", f"""
    WITH {SEGMENT_TOTAL_SQL}, ends AS (SELECT min(pos) AS a, max(pos) AS z FROM series),
    b AS (SELECT DISTINCT pos FROM series, ends WHERE pos >= a + 191 AND pos <= z - 24)
    {window_sql("b")}""")
def window_arrays(spark, sf):
    rows = sequence_window(hourly_totals(spark, sf, by_segment=True), 192, 24)
    return checked(rows.select("clust_id", F.col("pos").alias("base_pos"), "value_prev", "value_next"), "value_prev", "value_next")


@query("gathered_windows", f"WITH {SEGMENT_TOTAL_SQL}, {HOURLY_SPLIT_SQL} {window_sql('test')}")
def gathered_windows(spark, sf):
    rows = gather(hourly_totals(spark, sf, by_segment=True), hourly_split(spark, sf).test, 192, 24)
    return checked(rows, "prev", "next")


@query("window_marks", f"""
    WITH {HOURLY_TOTAL_SQL}, {HOURLY_SPLIT_SQL}
    SELECT t.pos AS base_pos, s.pos - t.pos AS step, month(s.time) AS month, day(s.time) AS day, isodow(s.time) - 1 AS weekday, hour(s.time) AS hour,
      round(s.value, 6) AS value
    FROM test t JOIN series s ON s.pos BETWEEN t.pos - {HOURLY.prev_times - 1} AND t.pos + {HOURLY.next_times}""")
def window_marks(spark, sf):
    """Time marks and value of each step of the test windows, past and future."""
    series = hourly_totals(spark, sf)
    marked = series.withColumns(time_marks(F.col("time")))
    rows = gather_steps(marked, hourly_split(spark, sf).test, HOURLY.prev_times, HOURLY.next_times, ["month", "day", "weekday", "hour", "value"])
    steps = rows.select("base_pos", F.posexplode(F.concat("prev", "next")).alias("at", "s"))
    return rounded(steps.select("base_pos", (F.col("at") - HOURLY.prev_times + 1).cast("long").alias("step"), "s.*"), 6, "value")


@query("seasonal_lags", f"""
    WITH {HOURLY_TOTAL_SQL}, {HOURLY_SPLIT_SQL},
    l AS (SELECT *, {", ".join(f"round(lag(value, {24 * j}) OVER (PARTITION BY clust_id ORDER BY pos), 6) AS lag_{j}" for j in range(1, 8))} FROM series)
    SELECT b.pos AS base_pos, h AS horizon, {", ".join(f"lag_{j}" for j in range(1, 8))}
    FROM bases b, (SELECT unnest(generate_series(1, 24)) AS h) JOIN l ON l.pos = b.pos + h""")
def skip_lags(spark, sf):
    series = hourly_totals(spark, sf)
    rows = seasonal_lags(horizon_targets(series, hourly_split(spark, sf).bases, HOURLY.next_times), series)
    return rows.select("base_pos", "horizon", *[F.round(F.col("skip_lags")[j - 1], 6).alias(f"lag_{j}") for j in range(1, 8)])


@query("trend_seasonal", f"""
    WITH {DAILY_TOTAL_SQL}, ends AS (SELECT min(pos) AS a, max(pos) AS z FROM series),
    t AS (SELECT s.pos, s.value, sum(n.value) / {KERNEL} AS trend
          FROM series s, ends, (SELECT unnest(generate_series(-{KERNEL // 2}, {KERNEL // 2})) AS k)
          JOIN series n ON n.pos = least(greatest(s.pos + k, a), z) GROUP BY 1, 2)
    SELECT pos, round(trend, 4) AS trend, round(value - trend, 4) AS seasonal FROM t""")
def trend_seasonal(spark, sf):
    return rounded(decompose(daily_series(spark, sf), KERNEL), 4, "trend", "seasonal").select("pos", "trend", "seasonal")


SEED_PREV, SEED_NEXT = 28, 7


@query("decoder_seed", f"""
    WITH {DAILY_TOTAL_SQL}, ends AS (SELECT min(pos) AS a, max(pos) AS z FROM series),
    b AS (SELECT pos FROM series, ends WHERE pos >= a + {SEED_PREV - 1} AND pos <= z - {SEED_NEXT}),
    w AS (SELECT b.pos AS base_pos, s.pos - b.pos + {SEED_PREV} AS i, ln(1 + s.value) AS v
          FROM b JOIN series s ON s.pos BETWEEN b.pos - {SEED_PREV - 1} AND b.pos),
    t AS (SELECT w.base_pos, w.i, w.v, sum(n.v) / {KERNEL} AS trend
          FROM w, (SELECT unnest(generate_series(-{KERNEL // 2}, {KERNEL // 2})) AS k)
          JOIN w n ON n.base_pos = w.base_pos AND n.i = least(greatest(w.i + k, 1), {SEED_PREV}) GROUP BY 1, 2, 3),
    m AS (SELECT base_pos, avg(v) AS mean FROM w GROUP BY 1)
    SELECT base_pos, round(sum(trend) + {SEED_NEXT} * any_value(mean), 6) AS trend_sum,
           round(sum(trend * (i - {SEED_PREV - LABEL_LEN})) + any_value(mean) * {sum(range(LABEL_LEN + 1, LABEL_LEN + SEED_NEXT + 1))}, 6) AS trend_weighted,
           round(sum(v - trend), 6) AS seasonal_sum, round(sum((v - trend) * (i - {SEED_PREV - LABEL_LEN})), 6) AS seasonal_weighted,
           {LABEL_LEN + SEED_NEXT} AS length
    FROM t JOIN m USING (base_pos) WHERE i > {SEED_PREV - LABEL_LEN} GROUP BY 1""")
def seeds(spark, sf):
    rows = sequence_window(daily_series(spark, sf), SEED_PREV, SEED_NEXT)
    rows = rows.select(F.col("pos").alias("base_pos"), F.transform("value_prev", lambda v: F.log1p(v)).alias("prev"))
    seeded = decoder_seed(rows, "prev", SEED_PREV, KERNEL, LABEL_LEN, SEED_NEXT)
    out = seeded.select(
        "base_pos", array_sum(F.col("trend_seed")).alias("trend_sum"), weighted(F.col("trend_seed")).alias("trend_weighted"),
        array_sum(F.col("seasonal_seed")).alias("seasonal_sum"), weighted(F.col("seasonal_seed")).alias("seasonal_weighted"),
        F.size("seasonal_seed").alias("length"))
    return rounded(out, 6, "trend_sum", "trend_weighted", "seasonal_sum", "seasonal_weighted")


@query("cluster_totals", f"WITH {SEGMENT_TOTAL_SQL} SELECT clust_id, pos, round(value, 6) AS value FROM series")
def segment_totals(spark, sf):
    totals = cluster_totals(hourly_series(spark, sf), segments(spark, sf))
    return rounded(totals.drop("time"), 6, "value")
