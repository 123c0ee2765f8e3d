"""Boosted trees against a plain version that tries every split."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from test_forecast import CONF, daily_meters, samples_of
from wattloom.operators.forecast import meter_samples
from wattloom.operators.trees import best_splits, cut_points, fit_trees, grow, predict_trees, tree_values
from wattloom.plans.experiment import run_model
from wattloom.sources.tables import read_table, write_table


def plain_tree(x, slope, depth, penalty):
    """Function that gives the value of a row, from splits tried one by one."""
    score = lambda rows: slope[rows].sum() ** 2 / (len(rows) + penalty)

    def build(rows, left):
        best = (1e-6, None)
        if left:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    gain = score(low) + score(high) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut, low, high))
        if best[1] is None:
            value = -slope[rows].sum() / (len(rows) + penalty)
            return lambda row: value
        f, cut, low, high = best[1]
        a, b = build(low, left - 1), build(high, left - 1)
        return lambda row: a(row) if row[f] <= cut else b(row)

    return build(np.arange(len(x)), depth)


def plain_boost(x, y, asked, rounds, depth, rate, penalty=1.0):
    made, out = np.full(len(y), y.mean()), np.full(len(asked), y.mean())
    for _ in range(rounds):
        tree = plain_tree(x, made - y, depth, penalty)
        made, out = made + rate * np.array([tree(r) for r in x]), out + rate * np.array([tree(r) for r in asked])
    return made, out


@pytest.mark.parametrize("rounds,depth", [(1, 1), (8, 3), (5, 6)])
def test_training_values_match_the_plain_version(rounds, depth):
    rng = np.random.default_rng(depth)
    x, y = rng.integers(0, 12, size=(70, 4)) / 2.0, rng.normal(size=70) * 10
    cuts = [cut_points(c) for c in x.T]
    table = np.array([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], np.uint8)
    start, features, places, leaves = grow(table, y, rounds, depth, 0.3, 1.0)
    values = np.array([cuts[f][c] if f >= 0 else 0 for f, c in zip(features.ravel(), places.ravel())])
    got = tree_values(x, depth, start, features.ravel(), values, leaves.ravel())
    np.testing.assert_allclose(got, plain_boost(x, y, x, rounds, depth, 0.3)[0], atol=1e-9)


def test_models_of_all_clusters_and_horizons(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, groups = rng.integers(0, 30, size=(120, 3)).astype(float), np.arange(120) % 2
    y = np.c_[np.where(x[:, 0] > 14, 10.0, -10.0) + groups, x[:, 1] * x[:, 2]]
    train = samples_of(spark, x, y, groups)
    write_table(fit_trees(train, rounds=6, depth=4), str(tmp_path / "trees"))
    made = predict_trees(read_table(spark, str(tmp_path / "trees")), train).collect()
    got = {(r.base_pos, r.horizon): r.pred_val for r in made}
    assert len(made) == 240 and {r.pos - r.base_pos - r.horizon for r in made} == {0}
    for g in (0, 1):
        for h in (0, 1):
            want = plain_boost(x[groups == g], y[groups == g, h], x[:0], 6, 4, 0.3)[0]
            np.testing.assert_allclose([got[i, h + 1] for i in np.flatnonzero(groups == g)], want, atol=1e-9)


def test_cut_points_are_bounded():
    assert cut_points(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    many = cut_points(np.random.default_rng(0).normal(size=5000))
    assert len(many) <= 255 and (np.diff(many) > 0).all() and not len(cut_points(np.ones(5)))


def test_slabs_of_features_give_the_same_splits(monkeypatch):
    rng = np.random.default_rng(4)
    table, slope, node = rng.integers(0, 9, (7, 50)).astype(np.uint8), rng.normal(size=50), rng.integers(-1, 4, 50)
    whole = best_splits(table, slope, node, 4, 9, 1.0)
    monkeypatch.setattr("wattloom.operators.trees.SLAB", 1)
    for a, b in zip(whole, best_splits(table, slope, node, 4, 9, 1.0)):
        np.testing.assert_allclose(a, b)


def test_meter_samples(spark):
    series = spark.createDataFrame([(m, p, m * 10.0 + p) for m in range(3) for p in range(5)] + [(9, p, None) for p in range(5)], "meter_id long, pos long, value double")
    clusters = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (9, 0)], "meter_id long, clust_id int")
    samples = spark.createDataFrame([(c, p, [0.5]) for c in (0, 1) for p in (1, 3)], "clust_id int, base_pos long, features array<double>")
    got = {(r.clust_id, r.base_pos): r.features for r in meter_samples(series, clusters, samples).collect()}
    assert got == {(0, 1): [1.0, 21.0, 0.5], (0, 3): [3.0, 23.0, 0.5], (1, 1): [11.0, 0.5], (1, 3): [13.0, 0.5]}
    with pytest.raises(PySparkException, match="meters without value at 3"):
        meter_samples(series.where("meter_id <> 2 OR pos <> 3"), clusters, samples).collect()


@pytest.mark.parametrize("model", ["linear", "gbt", "rbf"])
def test_runs_with_meters_as_features(spark, model):
    series, index = daily_meters(spark)
    _, errors, _, forecasts = run_model(series, index, CONF, model, meter_features=True)
    assert errors.first().mape < 8
    assert forecasts.select("pos").distinct().count() == forecasts.count()
    assert forecasts.where(F.col("pred_val").isNull()).isEmpty()
