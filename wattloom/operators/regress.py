"""Least squares for many groups and horizons from one grouped aggregate.

Per group the sums of products of features and targets are added up where the rows are; one row of sums
per group remains, and the small systems are solved in tasks, group by group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators.windows import dot


def product_sums(samples: DataFrame, groups: Sequence[str], features: str, targets: str) -> DataFrame:
    """Sums over each group of all products of (1, features) with (1, features, targets), row by row."""
    one = F.array(F.lit(1.0))
    left = F.concat(one, F.col(features))
    both = F.concat(one, F.col(features), F.col(targets))
    rows = samples.withColumns({"_l": left, "_r": both})
    products = F.flatten(F.transform("_l", lambda a: F.transform("_r", lambda b: a * b)))
    total = Summarizer.sum(F.col("_p"))
    return rows.withColumn("_p", array_to_vector(products)).groupBy(*groups).agg(
        vector_to_array(total).alias("sums"), F.max(F.size(features)).alias("width"))


def _least_norm(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Solution of least norm, its rank judged on columns scaled to equal length."""
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    kept = values > 1e-12 * values[-1]
    part = vectors[:, kept]
    weights = (part @ ((part.T @ (cross / scale[:, None])) / values[kept][:, None])) / scale[:, None]
    if kept.all():
        return weights
    free = vectors[:, ~kept] / scale[:, None]
    return weights - free @ np.linalg.lstsq(free, weights, rcond=None)[0]


def solve_sums(sums: np.ndarray, width: int, ridge: float, basis: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and coefficients (targets x features) of ridge or minimum-norm least squares.

    The intercept is not penalised. With a basis the model is linear in ``basis @ features``, the penalty
    applies there, and the coefficients are returned for the plain features.
    """
    table = sums.reshape(width + 1, -1)
    n = table[0, 0]
    mean = table[0, 1:] / n
    central = table[1:, 1:] - n * np.outer(mean[:width], mean)
    gram, cross = central[:, :width], central[:, width:]
    if basis is not None:
        gram, cross = basis @ gram @ basis.T, basis @ cross
    if ridge > 0:
        weights = np.linalg.solve(gram + ridge * np.eye(len(gram)), cross)
    else:
        weights = _least_norm(gram, cross)
    if basis is not None:
        weights = basis.T @ weights
    return mean[width:] - mean[:width] @ weights, weights.T


def fit_least_squares(samples: DataFrame, groups: Sequence[str] = ("clust_id",), features: str = "features",
                      targets: str = "targets", ridge: float = 0.0, basis: np.ndarray | None = None) -> DataFrame:
    """One model per group and target: groups, horizon (1-based), intercept, coef."""
    groups = list(groups)
    sums = product_sums(samples, groups, features, targets)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for record in part.to_dict("records"):
                bias, coef = solve_sums(np.asarray(record["sums"]), int(record["width"]), ridge, basis)
                for h in range(len(bias)):
                    rows.append([*(record[g] for g in groups), h + 1, float(bias[h]), coef[h].tolist()])
            yield pd.DataFrame(rows, columns=[*groups, "horizon", "intercept", "coef"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*groups).schema.fields)
    schema = f"{kept}{', ' if kept else ''}horizon int, intercept double, coef array<double>"
    return sums.mapInPandas(solve, schema)


def linear_value(features: Column, intercept: Column, coef: Column) -> Column:
    return intercept + dot(features, coef)
