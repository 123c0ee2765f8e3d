"""Mini-batch descent of the decomposed linear model: every batch is a slice of the training bases.

A step needs the weights of the step before, so a cluster is walked through by one task, all clusters side by side. The
samples of a cluster are bounded by the time grid. Every batch gives a row with its error; the model as it stands is added
at the batches at which it is evaluated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators.forecast import trend_basis
from wattloom.operators.regress import linear_value
from wattloom.operators.score import evaluated

#: Order of the bases in an epoch: by (base * TURN[0] + epoch * TURN[1]) modulo TURN[2], then by base.
TURN = (7919, 104729, 10007)


def batches_of(bases: np.ndarray, epochs: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Epoch and places of the bases of each batch; the last batch of an epoch may be smaller."""
    for epoch in range(1, epochs + 1):
        order = np.lexsort((bases, (bases * TURN[0] + epoch * TURN[1]) % TURN[2]))
        for begin in range(0, len(order), size):
            yield epoch, order[begin:begin + size]


def descend(x: np.ndarray, y: np.ndarray, bases: np.ndarray, k: int, epochs: int, size: int, rate: float, every: int) -> Iterator[tuple]:
    """Epoch, batch, mean squared error of the batch before its step and, at every ``every``-th batch, intercepts and
    coefficients of the window after it."""
    length = x.shape[1]
    basis, scale = trend_basis(length, k), x.mean()
    z = np.c_[(x / scale) @ basis.T, np.ones(len(x))]
    weights = np.full((2 * length + 1, y.shape[1]), 1.0 / length)
    weights[-1] = 0.0
    for batch, (epoch, rows) in enumerate(batches_of(bases, epochs, size), 1):
        error = z[rows] @ weights - y[rows] / scale
        weights = weights - rate / length * (z[rows].T @ error) / len(rows)
        kept = batch % every == 0
        yield epoch, batch, float((error**2).mean() * scale**2), (weights[-1] * scale).tolist() if kept else None, (basis.T @ weights[:-1]).T.tolist() if kept else None


def descend_windows(train: DataFrame, k: int = 11, epochs: int = 30, size: int = 16, rate: float = 0.5, every: int = 10,
                    keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """keys, epoch, batch (over all epochs), err_train, intercept and coef (an entry per horizon; null between evaluations).

    ``train`` holds windows of plain totals in ``features`` and the next totals in ``targets``. Totals are divided by their
    mean; the model starts as the mean of the window, for trend and season alike. A step goes ``rate`` / window length along
    the gradient of the squared error.
    """
    keys, kinds = list(keys), {f.name: f.dataType.simpleString() for f in train.schema.fields}

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("base_pos", kind="stable")
        steps = descend(np.stack(rows["features"]), np.stack(rows["targets"]), rows["base_pos"].to_numpy(), k, epochs, size, rate, every)
        made = pd.DataFrame(steps, columns=["epoch", "batch", "err_train", "intercept", "coef"])
        for place, key in enumerate(keys):
            made.insert(place, key, rows[key].iloc[0])
        return made

    kept = ", ".join(f"`{key}` {kinds[key]}" for key in keys)
    rows = train.select(*keys, "base_pos", F.col("features").cast("array<double>").alias("features"), F.col("targets").cast("array<double>").alias("targets"))
    return rows.groupBy(*keys).applyInPandas(walk, f"{kept}, epoch int, batch int, err_train double, intercept array<double>, coef array<array<double>>")


def evaluate_steps(steps: DataFrame, test: DataFrame, every: int = 10, keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """Forecasts of the test bases by the models at the evaluated batches: keys, epoch, batch, err_train, base_pos, horizon,
    pos, pred_val."""
    models = evaluated(steps, every).select(*keys, "epoch", "batch", "err_train", F.posexplode(F.arrays_zip("intercept", "coef")).alias("at", "m"))
    value = linear_value(F.col("features"), F.col("m.intercept"), F.col("m.coef"))
    horizon = F.col("at") + 1
    return test.select(*keys, "base_pos", "features").join(models, list(keys)).select(
        *keys, "epoch", "batch", "err_train", "base_pos", horizon.cast("int").alias("horizon"), (F.col("base_pos") + horizon).alias("pos"), value.alias("pred_val"))
