"""Mini-batch descent against a plain walk over the batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators.descent import TURN, batches_of, descend_windows, evaluate_steps
from wattloom.operators.forecast import trend_basis
from wattloom.operators.score import evaluated


def windows(spark, seed=0, clusters=2, count=37, length=8, ahead=3):
    rng = np.random.default_rng(seed)
    x = {c: rng.uniform(1, 3, size=(count, length)) * (c + 1) for c in range(clusters)}
    y = {c: x[c][:, -ahead:] + rng.normal(0, 0.05, size=(count, ahead)) for c in range(clusters)}
    rows = [(c, 100 + i, x[c][i].tolist(), y[c][i].tolist()) for c in x for i in range(count)]
    return x, y, spark.createDataFrame(rows, "clust_id int, base_pos long, features array<double>, targets array<double>")


def plain(x, y, bases, k, epochs, size, rate):
    """Weights and errors after every batch, one horizon and one sample at a time."""
    length, scale = x.shape[1], x.mean()
    z = np.array([[*(trend_basis(length, k) @ (row / scale)), 1.0] for row in x])
    w = np.array([[1 / length] * (2 * length) + [0.0] for _ in range(y.shape[1])])
    out = []
    for epoch in range(1, epochs + 1):
        order = sorted(range(len(bases)), key=lambda i: ((int(bases[i]) * TURN[0] + epoch * TURN[1]) % TURN[2], bases[i]))
        for begin in range(0, len(order), size):
            part = order[begin:begin + size]
            errors = [[sum(z[i] * w[h]) - y[i, h] / scale for i in part] for h in range(len(w))]
            w = np.array([w[h] - rate / length * sum(e * z[i] for e, i in zip(errors[h], part)) / len(part) for h in range(len(w))])
            out.append((epoch, np.mean(np.square(errors)) * scale**2, z @ w.T * scale))
    return out


def test_every_batch_matches_the_plain_walk(spark):
    x, y, train = windows(spark)
    steps = descend_windows(train.repartition(3), k=3, epochs=2, size=5, rate=0.5, every=4)
    rows = {(r.clust_id, r.batch): r for r in steps.collect()}
    assert len(rows) == 2 * 2 * 8
    made = {(r.clust_id, r.batch, r.base_pos, r.horizon): r for r in evaluate_steps(steps, train, every=4).collect()}
    assert len(made) == 2 * 4 * 37 * 3
    for c in (0, 1):
        for batch, (epoch, error, values) in enumerate(plain(x[c], y[c], np.arange(100, 137), 3, 2, 5, 0.5), 1):
            row = rows[c, batch]
            assert row.epoch == epoch and row.err_train == pytest.approx(error, rel=1e-9)
            assert (row.coef is None) == (batch % 4 != 0)
            if row.coef is not None:
                got = [[made[c, batch, 100 + i, h].pred_val for h in (1, 2, 3)] for i in range(37)]
                np.testing.assert_allclose(got, values, rtol=1e-9)
                assert made[c, batch, 100, 2].pos == 102 and made[c, batch, 100, 2].err_train == row.err_train


def test_evaluation_drops_batches_and_errors_fall(spark):
    _, _, train = windows(spark, seed=1, clusters=1, count=64)
    steps = descend_windows(train, k=3, epochs=12, size=16, rate=1.0, every=10)
    assert steps.count() == 48 and evaluated(steps, 10).count() == 4
    by_epoch = [r.e for r in steps.groupBy("epoch").agg(F.avg("err_train").alias("e")).orderBy("epoch").collect()]
    assert by_epoch[-1] < 0.5 * by_epoch[0]


def test_batches_cover_every_base_once_an_epoch():
    bases = np.arange(50) * 3
    seen = {}
    for epoch, rows in batches_of(bases, 3, 16):
        seen.setdefault(epoch, []).append(rows.tolist())
    assert all(sorted(sum(parts, [])) == list(range(50)) and [len(p) for p in parts] == [16, 16, 16, 2] for parts in seen.values())
    assert seen[1] != seen[2]


def test_no_samples(spark):
    _, _, train = windows(spark, clusters=1)
    assert descend_windows(train.where("false")).count() == 0
