"""Stored principal components against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import forecast as fc
from wattloom.operators import reduce
from wattloom.operators.reduce import Components, apply_components, apply_feature_axes, fit_components, fit_feature_axes
from wattloom.plans.experiment import experiment_grid, run_grid, run_model
from wattloom.sources.tables import read_table, write_table
from test_forecast import CONF, daily_meters


def vectors_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "meter_id long, profile array<double>")


def numpy_axes(x, k):
    _, size, right = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = np.zeros((k, x.shape[1]))
    axes[:min(k, len(right))] = np.where((size > 1e-9 * size[0])[:, None], right, 0)[:k]
    return np.array([a if a[abs(a).argmax()] >= 0 else -a for a in axes])


@pytest.mark.parametrize("rows,width,k", [(30, 200, 2), (200, 7, 3), (3, 40, 5), (60, 90, 4)])
def test_components_match_numpy(spark, rows, width, k):
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, width)) * np.linspace(1, 3, width) + 50
    model = fit_components(vectors_of(spark, x).repartition(3), k)
    np.testing.assert_allclose(model.axes, numpy_axes(x, k), atol=1e-7)
    np.testing.assert_allclose(model.mean, x.mean(0))


def test_planted_axes_are_found_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    planted = np.linalg.qr(rng.normal(size=(600, 2)))[0].T
    x = rng.normal(size=(120, 2)) * [40, 20] @ planted + rng.normal(0, 0.01, size=(120, 600))
    passes, whole = [], reduce._pass
    monkeypatch.setattr(reduce, "_pass", lambda *a: passes.append(1) or whole(*a))
    model = fit_components(vectors_of(spark, x), 2)
    np.testing.assert_allclose(model.axes, numpy_axes(x, 2), atol=1e-6)
    assert np.linalg.norm(model.axes @ planted.T) > 0.9999 * 2**0.5 and len(passes) <= 5  # the planted plane


def test_model_is_stored_and_applied_to_other_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, other = rng.normal(size=(40, 6)), rng.normal(size=(5, 6))
    write_table(fit_components(vectors_of(spark, x), 2).table(spark), str(tmp_path / "model"))
    model = Components.of(read_table(spark, str(tmp_path / "model")))
    got = [r.reduced for r in apply_components(vectors_of(spark, other), model).orderBy("meter_id").collect()]
    np.testing.assert_allclose(got, (other - x.mean(0)) @ numpy_axes(x, 2).T, atol=1e-8)


def test_no_vectors_and_equal_vectors(spark):
    none = vectors_of(spark, np.zeros((1, 3))).where("false")
    assert fit_components(none, 2).axes.shape == (2, 0)
    same = fit_components(vectors_of(spark, np.ones((4, 3))), 2)
    assert not same.axes.any() and not same.spread.any()


def test_feature_axes_per_cluster(spark):
    rng = np.random.default_rng(5)
    x = {c: rng.normal(size=(30, 5)) @ rng.normal(size=(5, 5)) + c for c in (0, 1)}
    rows = [(c, i, x[c][i].tolist(), [1.0]) for c in x for i in range(30)]
    samples = spark.createDataFrame(rows, "clust_id int, base_pos long, features array<double>, targets array<double>")
    train, test = samples.where("base_pos < 20"), samples.where("base_pos >= 20")
    out = apply_feature_axes(test, fit_feature_axes(train, 2))
    assert out.columns == samples.columns
    for c in x:
        got = [r.features for r in out.where(F.col("clust_id") == c).orderBy("base_pos").collect()]
        np.testing.assert_allclose(got, (x[c][20:] - x[c][:20].mean(0)) @ numpy_axes(x[c][:20], 2).T, atol=1e-8)


def test_all_components_forecast_like_the_features(spark):
    """Least squares does not care for a rotation; with fewer components the fit is another one."""
    rng = np.random.default_rng(6)
    rows = [(0, i, rng.normal(size=4).tolist(), rng.normal(size=2).tolist()) for i in range(40)]
    samples = spark.createDataFrame(rows, "clust_id int, base_pos long, features array<double>, targets array<double>")
    axes = fit_feature_axes(samples, 4)
    turned = apply_feature_axes(samples, axes)
    values = lambda models, test: [r.pred_val for r in fc.predict_direct(models, test).orderBy("base_pos", "horizon").collect()]
    np.testing.assert_allclose(values(fc.fit_linear(turned), turned), values(fc.fit_linear(samples), samples), atol=1e-9)


def test_runs_with_reduced_features(spark, tmp_path):
    series, index = daily_meters(spark)
    _, errors, timings, _ = run_model(series, index, CONF, "ar", feature_dims=3)
    seconds = {r.stage: r.seconds for r in timings.collect()}
    assert seconds["REDUCE_DIM_FEATURE"] > 0 and errors.first().mape < 5
    with pytest.raises(ValueError, match="cannot be reduced"):
        run_model(series, index, CONF, "persistence", feature_dims=3)
    grid = experiment_grid(spark, ("ar",), ("summer",), reps=1, feature_dims=(None, 2)).where("n_cluster = 1")
    assert sorted(r.run_code for r in grid.collect()) == ["ar_noCluster_noFeatureReduce_summer", "ar_noCluster_pca(2)_summer"]
    assert run_grid(series, index, grid, str(tmp_path), CONF) == 2
