import math

import pytest
from conftest import rows

from wattloom.operators.score import (
    batch_errors, best_checkpoint, epoch_errors, error_table, evaluated, forecast_errors, sum_clusters, train_errors)


def test_errors_by_hand(spark):
    df = spark.createDataFrame([(1, 10.0, 12.0), (2, 20.0, 18.0)], "time int, act_val double, pred_val double")
    got = forecast_errors(df).first()
    assert got.mape == pytest.approx(15) and got.rmse == pytest.approx(2)
    assert got.nmae == pytest.approx(2 / 15) and got.nrmse == pytest.approx(2 / math.sqrt(250))
    zero = spark.createDataFrame([(1, 0.0, 3.0), (2, 20.0, 18.0)], "time int, act_val double, pred_val double")
    assert forecast_errors(zero).first().mape == pytest.approx(10)


def test_levels(spark):
    data = []
    for epoch in (1, 2):
        for batch in (10 * epoch, 10 * epoch + 5):
            for clust in (0, 1):
                for pos in (7, 8):
                    data.append((epoch, batch, clust, pos, 10.0, 10.0 + epoch + (batch % 10) / 5 + clust, float(100 * epoch + batch + clust)))
    df = spark.createDataFrame(data, "epoch int, batch int, clust_id int, pos long, act_val double, pred_val double, err_train double")
    # clusters add up: actual 20, error 2 * (epoch + extra) + 1
    errors = {(e, b): 2 * (e + (b % 10) / 5) + 1 for e in (1, 2) for b in (10 * e, 10 * e + 5)}
    got = {(r.epoch, r.batch): r for r in batch_errors(df).collect()}
    for key, err in errors.items():
        assert got[key].rmse == pytest.approx(err) and got[key].mape == pytest.approx(err / 20 * 100)
    by_epoch = {r.epoch: r for r in epoch_errors(df).collect()}
    assert by_epoch[1].rmse == pytest.approx((errors[(1, 10)] + errors[(1, 15)]) / 2)
    assert rows(train_errors(df), "epoch") == [(1, (2 * 110 + 1 + 2 * 115 + 1) / 2), (2, (2 * 220 + 1 + 2 * 225 + 1) / 2)]
    assert error_table(df).columns == ["epoch", "err_train", "mape", "rmse", "nmae", "nrmse"]
    assert sum_clusters(df, ("epoch", "batch", "pos")).count() == 8
    assert {r.batch for r in evaluated(batch_errors(df)).collect()} == {10, 20}
    assert best_checkpoint(batch_errors(df)).first()[:2] == (1, 10)


def test_rmse_is_at_least_mae(spark):
    df = spark.createDataFrame([(i, float(i + 1), float((i * 7) % 11)) for i in range(30)], "time int, act_val double, pred_val double")
    got = forecast_errors(df).first()
    mean = sum(i + 1 for i in range(30)) / 30
    assert got.rmse >= got.nmae * mean
