"""Persistence forecasts and their errors per run, epoch and batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators.descent import TURN, descend_windows, evaluate_steps
from wattloom.operators.forecast import persistence_pairs, persistence_ratio, predict_persistence, window_samples
from wattloom.operators.joins import attach_actuals
from wattloom.operators.score import (
    METRICS, batch_errors, best_checkpoint, error_table, evaluated, forecast_errors, sum_clusters, train_errors)
from wattloom.plans.inputs import HOURLY, HOURLY_SPLIT_SQL, SEGMENT_TOTAL_SQL, hourly_split, hourly_totals
from wattloom.plans.registry import query, rounded
from wattloom.session import cut_lineage

# epochs, bases of a batch, batches between evaluations, step length; window and kernel of the decomposition
EPOCHS, SIZE, EVERY, RATE = 3, 16, 10, 0.5
LENGTH, KERNEL = 24, 11

PAIR_SQL = f"""
    {SEGMENT_TOTAL_SQL}, {HOURLY_SPLIT_SQL},
    horizons AS (SELECT unnest(generate_series(1, 24)) AS horizon),
    pairs AS (
      SELECT y.clust_id, b.role, b.pos AS base_pos, horizon, y.pos, y.time, x.value AS x, y.value AS y
      FROM (SELECT pos, 'train' AS role FROM train UNION ALL SELECT pos, 'test' AS role FROM test) b, horizons
      JOIN series y ON y.pos = b.pos + horizon JOIN series x ON x.clust_id = y.clust_id AND x.pos = y.pos - 24),
    ratios AS (SELECT clust_id, horizon, sum(x * y) / sum(x * x) AS ratio FROM pairs WHERE role = 'train' GROUP BY 1, 2),
    forecasts AS (SELECT p.*, y AS act_val, ratio * x AS pred_val FROM pairs p JOIN ratios USING (clust_id, horizon) WHERE role = 'test')"""

ERROR_SQL = """avg(abs(a - p) / nullif(a, 0)) * 100 AS mape, sqrt(avg((a - p) * (a - p))) AS rmse,
    avg(abs(a - p)) / avg(abs(a)) AS nmae, sqrt(avg((a - p) * (a - p))) / sqrt(avg(a * a)) AS nrmse"""
ROUNDED_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)

def decomposed_sql(length: int, k: int) -> str:
    """Table ``z``: per sample the trend and the seasonal part of its window, divided by the scale of the cluster, and 1."""
    return f"""
    b AS (SELECT pos, 'train' AS role FROM train UNION ALL SELECT pos, 'test' AS role FROM test),
    w AS (SELECT s.clust_id AS grp, role, b.pos AS base, s.pos - b.pos + {length} AS i, s.value AS v
          FROM b JOIN series s ON s.pos BETWEEN b.pos - {length - 1} AND b.pos),
    scale AS (SELECT grp, avg(v) AS s FROM w WHERE role = 'train' GROUP BY 1),
    trends AS (SELECT w.grp, w.role, w.base, w.i, any_value(w.v) AS v, sum(n.v) / {k} AS trend
          FROM w, (SELECT unnest(generate_series(-{k // 2}, {k // 2})) AS d)
          JOIN w n ON n.grp = w.grp AND n.role = w.role AND n.base = w.base AND n.i = least(greatest(w.i + d, 1), {length}) GROUP BY 1, 2, 3, 4),
    z AS (SELECT grp, role, base, list_concat(list_concat(list(trend / s ORDER BY i), list((v - trend) / s ORDER BY i)), [1.0::DOUBLE]) AS z
          FROM trends JOIN scale USING (grp) GROUP BY 1, 2, 3)"""


# mini-batch descent step by step: the weights of a horizon follow from those of the step before
DESCENT_SQL = f"""
    {SEGMENT_TOTAL_SQL}, {HOURLY_SPLIT_SQL}, {decomposed_sql(LENGTH, KERNEL)},
    y AS (SELECT s.clust_id AS grp, b.role, b.pos AS base, list(s.value ORDER BY s.pos) AS y
          FROM b JOIN series s ON s.pos BETWEEN b.pos + 1 AND b.pos + 24 GROUP BY 1, 2, 3),
    dealt AS (SELECT grp, epoch, base, z, y, row_number() OVER (PARTITION BY grp, epoch ORDER BY (base * {TURN[0]} + epoch * {TURN[1]}) % {TURN[2]}, base) - 1 AS n
          FROM z JOIN y USING (grp, role, base), (SELECT unnest(generate_series(1, {EPOCHS})) AS epoch) WHERE role = 'train'),
    slices AS (SELECT grp, epoch, n // {SIZE} AS k, list(z ORDER BY n) AS xs, list(y ORDER BY n) AS ys, count(*) AS c FROM dealt GROUP BY 1, 2, 3),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY epoch, k) AS batch FROM slices),
    walk(grp, h, batch, epoch, w) AS (
      SELECT grp, h, 0::BIGINT, 0::BIGINT, list_concat(list_transform(range({2 * LENGTH}), lambda i: 1.0::DOUBLE / {LENGTH}), [0.0::DOUBLE])
      FROM scale, (SELECT unnest(generate_series(1, 24)) AS h)
      UNION ALL
      SELECT grp, h, batch, epoch, list_transform(range(1, {2 * LENGTH + 2}),
               lambda i: w[i] - {RATE / LENGTH!r}::DOUBLE / c * list_sum(list_transform(range(1, c + 1), lambda b: e[b] * xs[b][i])))
      FROM (SELECT walk.grp, h, n.batch, n.epoch, w, xs, c, list_transform(range(1, c + 1), lambda b: list_sum(list_transform(range(1, {2 * LENGTH + 2}), lambda i: xs[b][i] * w[i])) - ys[b][h] / s) AS e
            FROM walk JOIN numbered n ON n.grp = walk.grp AND n.batch = walk.batch + 1 JOIN scale ON scale.grp = walk.grp)),
    tr AS (SELECT grp, epoch, batch, avg(x * x) AS err_train FROM (
             SELECT walk.grp, n.epoch, n.batch, unnest(list_transform(range(1, c + 1), lambda b: s * list_sum(list_transform(range(1, {2 * LENGTH + 2}), lambda i: xs[b][i] * w[i])) - ys[b][h])) AS x
             FROM walk JOIN numbered n ON n.grp = walk.grp AND n.batch = walk.batch + 1 JOIN scale ON scale.grp = walk.grp) GROUP BY 1, 2, 3),
    iterates AS (SELECT grp, epoch, batch, z.base + h AS pos, y.y[h] AS act_val, s * list_sum(list_transform(range(1, {2 * LENGTH + 2}), lambda i: z.z[i] * w[i])) AS pred_val
           FROM walk JOIN z USING (grp) JOIN y USING (grp, role, base) JOIN scale USING (grp) WHERE role = 'test' AND batch > 0 AND batch % {EVERY} = 0),
    totals AS (SELECT epoch, batch, pos, sum(act_val) AS a, sum(pred_val) AS p FROM iterates GROUP BY 1, 2, 3),
    be AS (SELECT epoch, batch, {ERROR_SQL} FROM totals GROUP BY 1, 2),
    te AS (SELECT epoch, avg(err_train) AS err_train FROM (SELECT epoch, batch, sum(err_train) AS err_train FROM tr WHERE batch % {EVERY} = 0 GROUP BY 1, 2) GROUP BY 1)"""


def pairs(spark, sf):
    """Totals are computed once and written; training and test pairs read the small result."""
    series = cut_lineage(hourly_totals(spark, sf, by_segment=True))
    every = persistence_pairs(series, hourly_split(spark, sf).base_roles(), HOURLY.next_times)
    return series, every.where("role = 'train'").drop("role"), every.where("role = 'test'").drop("role")


def forecasts(spark, sf):
    series, train, test = pairs(spark, sf)
    return attach_actuals(predict_persistence(persistence_ratio(train), test), series)


def steps(spark, sf):
    """Totals, every batch of the descent with its error, and the windows of the test bases."""
    series = cut_lineage(hourly_totals(spark, sf, by_segment=True))
    samples = cut_lineage(window_samples(series, hourly_split(spark, sf).base_roles(), LENGTH, HOURLY.next_times, log=False))
    made = cut_lineage(descend_windows(samples.where("role = 'train'"), KERNEL, EPOCHS, SIZE, RATE, EVERY))
    return series, made, samples.where("role = 'test'")


def iterates(spark, sf):
    series, made, test = steps(spark, sf)
    return attach_actuals(evaluate_steps(made, test, EVERY), series)


@query("batch_train_errors", f"WITH RECURSIVE {DESCENT_SQL} SELECT grp AS clust_id, epoch, batch, round(err_train, 4) AS err_train FROM tr")
def errors_of_every_batch(spark, sf):
    return rounded(steps(spark, sf)[1].select("clust_id", "epoch", "batch", "err_train"), 4, "err_train")


@query("evaluated_batches", f"""
    WITH RECURSIVE {DESCENT_SQL} SELECT grp AS clust_id, epoch, batch, round(err_train, 4) AS err_train FROM tr WHERE batch % {EVERY} = 0""")
def evaluated_batches(spark, sf):
    return rounded(evaluated(steps(spark, sf)[1], EVERY).select("clust_id", "epoch", "batch", "err_train"), 4, "err_train")


@query("persistence_ratio", f"WITH {PAIR_SQL} SELECT clust_id, horizon, round(ratio, 9) AS ratio FROM ratios")
def ratios(spark, sf):
    return rounded(persistence_ratio(pairs(spark, sf)[1]), 9, "ratio")


@query("forecast_rows", f"""
    WITH {PAIR_SQL} SELECT clust_id, base_pos, horizon, pos, CAST(time AS VARCHAR) AS time,
      round(act_val, 6) AS act_val, round(pred_val, 6) AS pred_val FROM forecasts""")
def forecast_rows(spark, sf):
    rows = forecasts(spark, sf).withColumn("time", F.col("time").cast("string"))
    return rounded(rows, 6, "act_val", "pred_val")


@query("forecast_errors", f"""
    WITH {PAIR_SQL}, totals AS (SELECT time, sum(act_val) AS a, sum(pred_val) AS p FROM forecasts GROUP BY 1)
    SELECT {ROUNDED_SQL} FROM (SELECT {ERROR_SQL} FROM totals)""")
def run_errors(spark, sf):
    return rounded(forecast_errors(sum_clusters(forecasts(spark, sf))), 6, *METRICS)


@query("batch_errors", f"WITH RECURSIVE {DESCENT_SQL} SELECT epoch, batch, {ROUNDED_SQL} FROM be")
def errors_by_batch(spark, sf):
    return rounded(batch_errors(iterates(spark, sf)), 6, *METRICS)


@query("epoch_errors", f"""
    WITH RECURSIVE {DESCENT_SQL} SELECT epoch, round(any_value(err_train), 4) AS err_train, {", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)}
    FROM be JOIN te USING (epoch) GROUP BY 1""")
def errors_by_epoch(spark, sf):
    rows = error_table(cut_lineage(iterates(spark, sf)))
    return rounded(rounded(rows, 6, *METRICS), 4, "err_train")


@query("train_errors", f"WITH RECURSIVE {DESCENT_SQL} SELECT epoch, round(err_train, 4) AS err_train FROM te")
def errors_in_training(spark, sf):
    return rounded(train_errors(iterates(spark, sf)), 4, "err_train")


@query("best_checkpoint", f"WITH RECURSIVE {DESCENT_SQL} SELECT epoch, batch, round(mape, 6) AS mape FROM be ORDER BY be.mape, epoch, batch LIMIT 1")
def best_batch(spark, sf):
    return rounded(best_checkpoint(batch_errors(iterates(spark, sf)), EVERY), 6, "mape")
