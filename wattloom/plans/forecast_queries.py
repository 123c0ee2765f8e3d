"""Fitted forecasts and the table of runs. The SQL solves the same normal equations by elimination."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wattloom.operators import forecast as fc
from wattloom.operators.joins import attach_actuals
from wattloom.operators.score import METRICS, forecast_errors, sum_clusters
from wattloom.operators.series import cluster_totals, single_cluster
from wattloom.operators.wide import forecast_meters
from wattloom.plans.experiment import experiment_grid, ClusterSetup, forecast_model, with_calendar
from wattloom.plans.inputs import (
    DAILY, DAILY_TOTAL_SQL, HOURLY, HOURLY_SPLIT_SQL, HOURLY_TOTAL_SQL, SEGMENT_TOTAL_SQL, daily_series, daily_split,
    hourly_series, hourly_split, hourly_totals, split_sql)
from wattloom.plans.registry import query, rounded
from wattloom.plans.score_queries import ERROR_SQL
from wattloom.session import cut_lineage

FLAGS = [f"CAST(isodow(time) = {k} AS INTEGER)" for k in range(1, 7)]
HOUR_CYCLE = [f"{f}({2 * math.pi!r} * hour(time) / 24.0)" for f in ("sin", "cos")]
RBF_COUNT, RBF_RIDGE = 64, 1.0


def roles_sql() -> str:
    return "b AS (SELECT pos, 'train' AS role FROM train UNION ALL SELECT pos, 'test' AS role FROM test)"


def target_sql(next_times: int) -> str:
    return f"""
    targs AS (SELECT s.clust_id AS grp, b.role, b.pos AS base, s.pos - b.pos AS h, s.value AS y
              FROM b JOIN series s ON s.pos BETWEEN b.pos + 1 AND b.pos + {next_times})"""


def fixed_features_sql(expressions: list[str]) -> str:
    """Features of the base row itself, number 0 being the constant."""
    rows = " UNION ALL ".join(
        f"SELECT clust_id AS grp, role, b.pos AS base, {i} AS i, CAST({e} AS DOUBLE) AS x FROM b JOIN series s USING (pos)"
        for i, e in enumerate(["1", *expressions]))
    return f"feats AS ({rows})"


def solve_sql(width: int | str, ridge: float = 0.0) -> str:
    """Tables ``coef`` and ``pred`` from ``feats`` and ``targs`` by Gauss-Jordan elimination; ``width``: largest feature number."""
    return f"""
    sums AS (
      SELECT l.grp, l.i, r.j, sum(l.x * r.x) + CASE WHEN l.i = r.j AND l.i > 0 THEN {ridge} ELSE 0 END AS v
      FROM feats l JOIN (SELECT grp, role, base, i AS j, x FROM feats UNION ALL SELECT grp, role, base, {width} + h, y FROM targs) r
        ON l.grp = r.grp AND l.base = r.base AND l.role = r.role
      WHERE l.role = 'train' GROUP BY 1, 2, 3),
    gj(k, grp, i, j, v) AS (
      SELECT 0, grp, i, j, v FROM sums
      UNION ALL
      SELECT k + 1, grp, i, j, CASE WHEN i = k THEN v / piv ELSE v - f * pr / piv END FROM (
        SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY grp) AS piv,
               max(CASE WHEN i = k THEN v END) OVER (PARTITION BY grp, j) AS pr,
               max(CASE WHEN j = k THEN v END) OVER (PARTITION BY grp, i) AS f
        FROM gj WHERE k <= {width})),
    coef AS (SELECT grp, i, j - {width} AS h, v FROM gj WHERE k = {width} + 1 AND j > {width}),
    pred AS (SELECT f.grp, f.base, h, sum(f.x * v) AS p FROM feats f JOIN coef ON coef.grp = f.grp AND coef.i = f.i
             WHERE role = 'test' GROUP BY 1, 2, 3),
    fitted AS (SELECT pred.grp, pred.base, pred.h, y AS a, p FROM pred
               JOIN targs t ON t.grp = pred.grp AND t.base = pred.base AND t.h = pred.h AND t.role = 'test')"""


def forecast_sql(series: str, split: str, next_times: int, features: str, width: int | str, ridge: float, places: int) -> str:
    return f"""
    WITH RECURSIVE {series}, {split}, {roles_sql()}, {target_sql(next_times)}, {features}, {solve_sql(width, ridge)}
    SELECT grp AS clust_id, base AS base_pos, h AS horizon, round(a, 6) AS act_val, round(p, {places}) AS pred_val FROM fitted"""


def result(forecasts, totals, places: int):
    rows = attach_actuals(forecasts, totals).select("clust_id", "base_pos", "horizon", "act_val", "pred_val")
    return rounded(rounded(rows, 6, "act_val"), places, "pred_val")


LINEAR = ["value", *HOUR_CYCLE, *FLAGS]


@query("forecast_linear", forecast_sql(
    SEGMENT_TOTAL_SQL, HOURLY_SPLIT_SQL, 24, fixed_features_sql(LINEAR), len(LINEAR), 0.0, 3))
def forecast_linear(spark, sf):
    totals, features = with_calendar(cut_lineage(hourly_totals(spark, sf, by_segment=True)))
    return result(forecast_model(totals, hourly_split(spark, sf), "linear", features), totals, 3)


def lag_features_sql(length: int) -> str:
    return f"""
    feats AS (
      SELECT s.clust_id AS grp, role, b.pos AS base, s.pos - b.pos + {length} AS i, ln(1 + s.value) AS x
      FROM b JOIN series s ON s.pos BETWEEN b.pos - {length - 1} AND b.pos
      UNION ALL SELECT DISTINCT s.clust_id, role, b.pos, 0, 1.0 FROM b JOIN series s USING (pos))"""


@query("forecast_ar", forecast_sql(SEGMENT_TOTAL_SQL, HOURLY_SPLIT_SQL, 24, lag_features_sql(24), 24, 0.0, 3))
def forecast_ar(spark, sf):
    totals = cut_lineage(hourly_totals(spark, sf, by_segment=True))
    return result(forecast_model(totals, hourly_split(spark, sf), "ar"), totals, 3)


def decomposed_features_sql(length: int, k: int) -> str:
    return f"""
    w AS (SELECT s.clust_id AS grp, role, b.pos AS base, s.pos - b.pos + {length} AS i, ln(1 + s.value) AS v
          FROM b JOIN series s ON s.pos BETWEEN b.pos - {length - 1} AND b.pos),
    t AS (SELECT w.grp, w.role, w.base, w.i, w.v, sum(n.v) / {k} AS trend
          FROM w, (SELECT unnest(generate_series(-{k // 2}, {k // 2})) AS d)
          JOIN w n ON n.grp = w.grp AND n.role = w.role AND n.base = w.base AND n.i = least(greatest(w.i + d, 1), {length})
          GROUP BY 1, 2, 3, 4, 5),
    feats AS (
      SELECT grp, role, base, i, trend AS x FROM t UNION ALL SELECT grp, role, base, i + {length}, v - trend FROM t
      UNION ALL SELECT DISTINCT grp, role, base, 0, 1.0 FROM t)"""


SUMMER = DAILY["summer"]


@query("forecast_dlinear", forecast_sql(
    DAILY_TOTAL_SQL, split_sql(SUMMER), SUMMER.next_times, decomposed_features_sql(SUMMER.prev_times, 11),
    2 * SUMMER.prev_times, 1.0, -2))
def forecast_dlinear(spark, sf):
    totals = cut_lineage(daily_series(spark, sf))
    return result(forecast_model(totals, daily_split(spark, sf, "summer"), "dlinear"), totals, -2)


def fourier_sql(width: int, count: int) -> str:
    """The same fixed directions and phases, by formula."""
    steps = ", ".join(f"({j}, {s!r}::DOUBLE)" for j, s in enumerate(fc.even_steps(2 * width + 1).tolist(), 1))
    return f"""
    gamma AS (SELECT 1.0 / ({width} * var_pop(x)) AS gamma FROM raw WHERE role = 'train'),
    steps_(j, s) AS (VALUES {steps}),
    spread AS (SELECT d, j, (0.5::DOUBLE + d * s) % 1 AS u FROM (SELECT unnest(generate_series(1, {count})) AS d), steps_),
    dirs AS (SELECT a.d, a.j AS i, sqrt(-2 * ln(a.u)) * cos({2 * math.pi!r} * c.u) AS w
             FROM spread a JOIN spread c ON c.d = a.d AND c.j = a.j + {width} WHERE a.j <= {width}),
    feats AS (
      SELECT grp, role, base, dirs.d AS i,
             {math.sqrt(2.0 / count)!r} * cos(sqrt(2 * any_value(gamma)) * sum(w * x) + {2 * math.pi!r} * any_value(ph.u)) AS x
      FROM raw JOIN dirs USING (i) JOIN spread ph ON ph.d = dirs.d AND ph.j = {2 * width + 1}, gamma GROUP BY grp, role, base, dirs.d
      UNION ALL SELECT DISTINCT grp, role, base, 0, 1.0 FROM raw)"""


METER_RIDGE = 1.0


def meter_features_sql(flags: list[str]) -> str:
    """The time variables, then the value of each meter, numbered by id."""
    rows = " UNION ALL ".join(
        f"SELECT 0 AS grp, role, b.pos AS base, {i} AS i, CAST({e} AS DOUBLE) AS x FROM b JOIN series s USING (pos)"
        for i, e in enumerate(["1", *flags]))
    return f"""
    feats AS (
      SELECT 0 AS grp, role, b.pos AS base, {len(flags)} + m.rn AS i, f.value AS x
      FROM b JOIN filled f USING (pos) JOIN (SELECT meter_id, row_number() OVER (ORDER BY meter_id) AS rn FROM (SELECT DISTINCT meter_id FROM filled)) m USING (meter_id)
      UNION ALL {rows})"""


@query("forecast_meters", forecast_sql(
    HOURLY_TOTAL_SQL, HOURLY_SPLIT_SQL, 24, meter_features_sql([*HOUR_CYCLE, *FLAGS]), "(SELECT max(i) FROM feats)", METER_RIDGE, 3))
def forecast_from_meters(spark, sf):
    series = cut_lineage(hourly_series(spark, sf))
    totals, features = with_calendar(cut_lineage(cluster_totals(series)))
    samples = fc.supervised(totals, hourly_split(spark, sf).base_roles(), HOURLY.next_times, features)
    samples = cut_lineage(samples.withColumn("features", F.slice("features", 2, len(features))))
    return result(forecast_meters(series, single_cluster(series), samples, METER_RIDGE), totals, 3)


RBF_FEATURES = fixed_features_sql(LINEAR).replace("feats AS", "raw0 AS") + ", raw AS (SELECT * FROM raw0 WHERE i > 0), " \
    + fourier_sql(len(LINEAR), RBF_COUNT)


@query("forecast_rbf", forecast_sql(
    HOURLY_TOTAL_SQL, HOURLY_SPLIT_SQL, 24, RBF_FEATURES, RBF_COUNT, RBF_RIDGE, 3))
def forecast_rbf(spark, sf):
    totals, features = with_calendar(cut_lineage(hourly_totals(spark, sf)))
    split = hourly_split(spark, sf)
    samples = cut_lineage(fc.supervised(totals, split.base_roles(), HOURLY.next_times, features))
    train, test = (samples.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    gamma, width = fc.scale_gamma(train).scalar(), 1 + len(features)
    train, test = (fc.fourier_features(p, width, gamma, RBF_COUNT) for p in (train, test))
    return result(fc.predict_direct(fc.fit_rbf(train, ridge=RBF_RIDGE), test), totals, 3)


@query("forecast_svr")
def forecast_svr(spark, sf):
    """Kernel regression with the insensitive loss, on the samples and waves of ``forecast_rbf``."""
    totals, features = with_calendar(cut_lineage(hourly_totals(spark, sf)))
    samples = cut_lineage(fc.supervised(totals, hourly_split(spark, sf).base_roles(), HOURLY.next_times, features))
    train, test = (samples.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    return result(fc.forecast_kernel(train, test, RBF_COUNT), totals, 1)


def daily_samples(spark, sf):
    """Last week of log totals at the summer bases, training and test part."""
    totals, split = cut_lineage(daily_series(spark, sf)), daily_split(spark, sf, "summer")
    samples = fc.window_samples(totals, split.base_roles(), SUMMER.next_times, SUMMER.next_times)
    samples = cut_lineage(samples)
    return totals, *(samples.where(F.col("role") == r).drop("role") for r in ("train", "test"))


@query("forecast_gbt")
def forecast_gbt(spark, sf):
    totals, train, test = daily_samples(spark, sf)
    return result(fc.forecast_gbt(train, test), totals, 1)


@query("forecast_huber")
def forecast_huber(spark, sf):
    totals, train, test = daily_samples(spark, sf)
    return result(fc.forecast_huber(train, test, SUMMER.next_times), totals, 1)


RUN_MODELS = ("persistence", "linear", "ar")


def run_sql() -> str:
    parts = []
    for season, conf in DAILY.items():
        body = f"{DAILY_TOTAL_SQL}, {split_sql(conf)}, {roles_sql()}, {target_sql(conf.next_times)}"
        pairs = f"""
        pairs AS (SELECT t.*, x.value AS x FROM targs t JOIN series x ON x.clust_id = t.grp AND x.pos = t.base + t.h - {conf.next_times}),
        ratios AS (SELECT grp, h, sum(x * y) / sum(x * x) AS ratio FROM pairs WHERE role = 'train' GROUP BY 1, 2),
        totals AS (SELECT base + h AS pos, sum(y) AS a, sum(ratio * x) AS p FROM pairs JOIN ratios USING (grp, h) WHERE role = 'test' GROUP BY 1)"""
        fitted = "totals AS (SELECT base + h AS pos, sum(a) AS a, sum(p) AS p FROM fitted GROUP BY 1)"
        last = f"{fixed_features_sql(['value'])}, {solve_sql(1)}, {fitted}"
        lags = f"{lag_features_sql(conf.next_times)}, {solve_sql(conf.next_times)}, {fitted}"
        for model, rest in zip(RUN_MODELS, (pairs, last, lags), strict=True):
            parts.append(f"""
            SELECT '{model}_noCluster_noFeatureReduce_{season}' AS run_code, * FROM (
              WITH RECURSIVE {body}, {rest} SELECT {", ".join(f"round({m}, 6) AS {m}" for m in METRICS)} FROM (SELECT {ERROR_SQL} FROM totals))""")
    return " UNION ALL ".join(parts)


@query("run_table", run_sql())
def run_table(spark, sf):
    """Errors of each model and season on the daily totals, one row per run."""
    totals = cut_lineage(daily_series(spark, sf))
    settings = experiment_grid(spark, RUN_MODELS, tuple(DAILY), (ClusterSetup(),), 1).orderBy("run_code").collect()
    splits = {s: daily_split(spark, sf, s) for s in DAILY}
    rows = []
    for run in settings:
        made = attach_actuals(forecast_model(totals, splits[run["season"]], run["model"]), totals)
        rows.append(forecast_errors(sum_clusters(made)).withColumn("run_code", F.lit(run["run_code"])))
    whole = rows[0]
    for part in rows[1:]:
        whole = whole.unionByName(part)
    return rounded(whole, 6, *METRICS)
