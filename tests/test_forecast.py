import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wattloom.conf import ForecastConf
from wattloom.operators import forecast as fc
from wattloom.operators.joins import attach_actuals
from wattloom.operators.regress import fit_least_squares
from wattloom.operators.conjugate import Descent
from wattloom.operators.wide import forecast_meters
from wattloom.plans.experiment import ClusterSetup, experiment_grid, run_grid, run_model
from wattloom.sources.tables import read_table


def samples_of(spark, x, y, groups):
    data = [(int(g), i, [float(v) for v in a], [float(v) for v in b]) for i, (g, a, b) in enumerate(zip(groups, x, y))]
    return spark.createDataFrame(data, "clust_id int, base_pos long, features array<double>, targets array<double>")


def coefficients(models, clust, horizon):
    r = models.where((F.col("clust_id") == clust) & (F.col("horizon") == horizon)).first()
    return np.r_[r.intercept, r.coef]


def test_planted_coefficients_are_found(spark):
    rng = np.random.default_rng(0)
    x, groups = rng.normal(size=(200, 3)) + 100, np.arange(200) % 2
    w = {0: rng.normal(size=(3, 2)), 1: rng.normal(size=(3, 2))}
    y = np.array([a @ w[g] + 5 + g for a, g in zip(x, groups)])
    models = fc.fit_linear(samples_of(spark, x, y, groups))
    assert models.count() == 4
    for g in (0, 1):
        for h in (1, 2):
            np.testing.assert_allclose(coefficients(models, g, h), np.r_[5 + g, w[g][:, h - 1]], rtol=1e-6)
    pred = fc.predict_direct(models, samples_of(spark, x, y, groups)).where("base_pos = 7").orderBy("horizon").collect()
    np.testing.assert_allclose([r.pred_val for r in pred], y[7], rtol=1e-9)
    assert [r.pos for r in pred] == [8, 9]


def test_singular_features_give_the_minimum_norm_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2))
    x = np.c_[x, x[:, 0]]
    y = (x @ [1.0, 2.0, 1.0])[:, None]
    got = coefficients(fc.fit_linear(samples_of(spark, x, y, np.zeros(50))), 0, 1)
    np.testing.assert_allclose(got, [0, 1, 2, 1], atol=1e-9)


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 4)) + 2, rng.normal(size=(40, 1))
    got = coefficients(fit_least_squares(samples_of(spark, x, y, np.zeros(40)), ridge=3.0), 0, 1)
    xc, yc = x - x.mean(0), y - y.mean(0)
    w = np.linalg.solve(xc.T @ xc + 3 * np.eye(4), xc.T @ yc)[:, 0]
    np.testing.assert_allclose(got, np.r_[y.mean() - x.mean(0) @ w, w], rtol=1e-8)


def test_decomposed_linear_equals_ridge_on_both_parts(spark):
    rng = np.random.default_rng(3)
    length, k, ridge = 12, 5, 0.7
    x, y = rng.normal(size=(60, length)), rng.normal(size=(60, 2))
    basis = fc.trend_basis(length, k)
    smooth = np.array([np.convolve(np.r_[[v[0]] * 2, v, [v[-1]] * 2], np.ones(k) / k, "valid") for v in x])
    np.testing.assert_allclose(x @ basis.T, np.hstack([smooth, x - smooth]), atol=1e-12)
    models = fc.decomposed_linear(samples_of(spark, x, y, np.zeros(60)), length, k, ridge)
    phi = np.hstack([smooth, x - smooth])
    pc, yc = phi - phi.mean(0), y - y.mean(0)
    beta = np.linalg.solve(pc.T @ pc + ridge * np.eye(2 * length), pc.T @ yc)
    want = y.mean(0) + pc @ beta
    got = fc.predict_direct(models, samples_of(spark, x, y, np.zeros(60))).toPandas().pivot(index="base_pos", columns="horizon", values="pred_val")
    np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-7)
    with pytest.raises(ValueError):
        fc.decomposed_linear(samples_of(spark, x, y, np.zeros(60)), length, 4)


def test_persistence_recovers_a_daily_factor(spark):
    data = [(0, p, dt.datetime(2010, 1, 1) + dt.timedelta(hours=p), 2.0 ** (p // 24) * (1 + p % 24)) for p in range(24 * 6)]
    series = spark.createDataFrame(data, "clust_id int, pos long, time timestamp_ntz, value double")
    bases = spark.range(48, 100).withColumnRenamed("id", "pos")
    pairs = fc.persistence_pairs(series, bases, 24)
    ratios = fc.persistence_ratio(pairs)
    assert ratios.count() == 24 and all(r.ratio == pytest.approx(2) for r in ratios.collect())
    made = attach_actuals(fc.predict_persistence(ratios, pairs), series)
    assert made.where("abs(act_val - pred_val) > 1e-6").isEmpty() and made.count() == 52 * 24


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(5)
    x, count, gamma = rng.normal(size=(12, 3)), 2048, 0.3
    w, b = fc.fourier_frequencies(3, count)
    z = np.sqrt(2 / count) * np.cos(np.sqrt(2 * gamma) * x @ w.T + b)
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.15
    df = samples_of(spark, x, np.zeros((12, 1)), np.zeros(12))
    got = fc.fourier_features(df, 3, F.lit(gamma), 8).orderBy("base_pos").toPandas()["features"]
    w, b = fc.fourier_frequencies(3, 8)
    np.testing.assert_allclose(np.stack(got), np.sqrt(2 / 8) * np.cos(np.sqrt(2 * gamma) * x @ w.T + b), atol=1e-9)
    assert fc.scale_gamma(df).first().gamma == pytest.approx(1 / (3 * x.var()))


def test_trees_and_robust_fit_learn(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, size=(120, 2))
    y = np.c_[np.where(x[:, 0] > 0, 10.0, -10.0), 3 * x[:, 1]]
    train = samples_of(spark, x, y, np.zeros(120))
    made = fc.forecast_gbt(train, train, rounds=3, depth=2, rate=0.5)
    assert made.count() == 240
    error = made.where("horizon = 1").join(train.select("base_pos", F.col("targets")[0].alias("y")), "base_pos")
    assert error.agg(F.avg(F.abs(F.col("y") - F.col("pred_val")))).first()[0] < 3
    y[0, 1] = 1000.0
    robust = fc.forecast_huber(samples_of(spark, x, y, np.zeros(120)), train, 2).where("horizon = 2")
    error = robust.join(train.select("base_pos", F.col("targets")[1].alias("y")), "base_pos")
    assert error.agg(F.max(F.abs(F.col("y") - F.col("pred_val")))).first()[0] < 0.5


def wide_weights(x, y, ridge):
    xc, yc = x - x.mean(0), y - y.mean(0)
    return np.linalg.lstsq(xc, yc, rcond=None)[0] if ridge == 0 else np.linalg.solve(xc.T @ xc + ridge * np.eye(x.shape[1]), xc.T @ yc)


@pytest.mark.parametrize("meters,ridge,sent", [((6, 9), 0.0, 1 << 20), ((60, 3), 0.0, 1 << 20), ((60, 3), 2.0, 0), ((6, 9), 2.0, 0)])
def test_all_meters_match_numpy(spark, monkeypatch, meters, ridge, sent):
    """Two clusters, more bases or more meters, a base drawn twice, tables sent or joined."""
    monkeypatch.setattr("wattloom.operators.wide.SENT", sent)
    rng = np.random.default_rng(8)
    n, count = 40, sum(meters)
    v = rng.uniform(1, 5, size=(count, n + 2))
    rows = [(m, p, float(v[m, p])) for m in range(count) for p in range(n + 2)] + [(count, p, None) for p in range(n)]
    series = spark.createDataFrame(rows, "meter_id long, pos long, value double")
    clust = [0] * meters[0] + [1] * meters[1]
    clusters = spark.createDataFrame([*enumerate(clust), (count, 1)], "meter_id long, clust_id int")
    extra, train = rng.normal(size=n), [*range(30), 4, 4]
    data, want = [], {}
    for c in (0, 1):
        mine = v[np.array(clust) == c]
        total = mine.sum(0)
        x, y = np.c_[mine[:, :n].T, extra], np.c_[total[1:n + 1], total[2:n + 2]] ** 2
        w = wide_weights(x[train], y[train], ridge)
        want |= {(c, p, h): y[train].mean(0)[h] + (x[p] - x[train].mean(0)) @ w[:, h] for p in range(29, n) for h in (0, 1)}
        data += [(c, p, r, [float(extra[p])], y[p].tolist()) for r, ps in (("train", train), ("test", range(29, n))) for p in ps]
    samples = spark.createDataFrame(data, "clust_id int, base_pos long, role string, features array<double>, targets array<double>")
    got = {(r.clust_id, r.base_pos, r.horizon - 1): r.pred_val for r in forecast_meters(series, clusters, samples, ridge).collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-6)


def test_steps_grow_slower_than_meters():
    """All targets share the search space, so a fit takes about meters / targets steps."""
    rng = np.random.default_rng(0)
    x, targets = rng.gamma(1, 30, size=(300, 120)), 24
    x -= x.mean(0)
    goal = x.T @ rng.normal(size=(300, targets))
    solver, steps = Descent.of(goal, 1.0, 1e-11), 0
    while not solver.done:
        solver.step(x.T @ (x @ solver.ask), 1e-11)
        solver, steps = Descent.unpacked(solver.packed()), steps + 1
    assert steps <= 12
    np.testing.assert_allclose(solver.found, np.linalg.solve(x.T @ x + np.eye(120), goal), rtol=1e-7)


def test_solver_takes_collinear_columns_and_zero_targets():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 3)) @ rng.normal(size=(3, 30))
    y = np.c_[rng.normal(size=(20, 2)), np.zeros(20)]
    solver = Descent.of(x.T @ y, 0.0, 1e-11)
    while not solver.done:
        solver.step(x.T @ (x @ solver.ask), 1e-11)
    np.testing.assert_allclose(solver.found, np.linalg.lstsq(x, y, rcond=1e-10)[0], atol=1e-8)


def daily_meters(spark):
    start = dt.datetime(2009, 4, 1)
    rng = np.random.default_rng(9)
    data = []
    for m in range(6):
        for p in range(420):
            level = (5 if m < 3 else 50) * (1 + 0.3 * np.sin(2 * np.pi * p / 7))
            data.append((m, p, start + dt.timedelta(days=p), float(level + rng.normal(0, 0.1))))
    series = spark.createDataFrame(data, "meter_id long, pos long, time timestamp_ntz, value double")
    return series, series.where("meter_id = 0").select("pos", "time")


CONF = ForecastConf(prev_times=14, next_times=7)


@pytest.mark.parametrize("model", ["persistence", "linear", "ar", "dlinear", "rbf"])
def test_models_forecast_a_weekly_pattern(spark, model):
    series, index = daily_meters(spark)
    clusters, errors, timings, forecasts = run_model(series, index, CONF, model)
    assert errors.first().mape < 5
    assert {r.stage for r in timings.collect()} == {"REDUCE_DIM_CLUSTER", "CLUSTERING", "REDUCE_DIM_FEATURE", "LEARNING"}
    assert clusters.count() == 6 and forecasts.select("pos").distinct().count() == forecasts.count()


def test_grid_skips_finished_runs(spark, tmp_path):
    series, index = daily_meters(spark)
    setups = (ClusterSetup(2, "kmeans", "pca", 2), ClusterSetup())
    settings = experiment_grid(spark, ("persistence",), ("summer", "winter"), setups, 1)
    assert settings.count() == 4
    assert experiment_grid(spark, ("a", "b", "c", "d", "e", "f")).count() == 240
    settings = settings.where("season = 'summer' or n_cluster = 1")
    assert run_grid(series, index, settings.where("n_cluster = 4 or season = 'winter'"), str(tmp_path), CONF) == 1
    assert run_grid(series, index, settings, str(tmp_path), CONF) == 2
    assert run_grid(series, index, settings, str(tmp_path), CONF) == 0
    metrics = read_table(spark, f"{tmp_path}/metrics")
    assert metrics.count() == 3 and metrics.where("mape is null").isEmpty()
    pairs = rows(read_table(spark, f"{tmp_path}/clusters").where("run_code like '%kmeans%summer'").select("meter_id", "clust_id"), "meter_id")
    assert pairs == [(m, int(m >= 3)) for m in range(6)]
    dbscan = ClusterSetup(2, "dbscan", "pca", 2)
    assert run_model(series, index, CONF, "persistence", dbscan)[0].select("clust_id").distinct().count() == 1
    with pytest.raises(ValueError):
        run_model(series, index, CONF, "unknown")
