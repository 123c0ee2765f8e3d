"""Regression that ignores errors up to epsilon and counts larger ones as they are, for many groups and horizons.

The loss max(|r|, epsilon) - epsilon is half of |r - epsilon| + |r + epsilon|, less epsilon. Each absolute value lies below a
parabola that touches it at the present residual, so every round is a weighted ridge system and lowers the objective. A round
is one pass over packed blocks of samples: a block needs only the models of its group, adds up its weighted products, and
holds no state of its own, so a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut_lineage

# Samples of a packed block, about.
BLOCK = 1024


def _packed(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of samples: keys, _x and _y as flat arrays with their widths; rows without features or targets count nowhere."""
    whole = samples.where("features is not null and targets is not null").select(*keys, "base_pos", "features", "targets")
    sizes = whole.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    dealt = whole.join(sizes, list(keys)).withColumn("_blk", F.pmod(F.xxhash64("base_pos"), F.col("_n")))
    blocks = dealt.groupBy(*keys, "_blk").agg(
        F.max(F.size("features")).cast("int").alias("_p"), F.max(F.size("targets")).cast("int").alias("_h"),
        F.flatten(F.collect_list(F.struct("features", "targets"))["features"]).alias("_x"),
        F.flatten(F.collect_list(F.struct("features", "targets"))["targets"]).alias("_y"))
    return cut_lineage(blocks)


def weights_of(residual: np.ndarray, epsilon: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and shift of the parabolas that touch the loss at ``residual``."""
    above = 0.5 / np.maximum(np.abs(residual - epsilon), least)
    below = 0.5 / np.maximum(np.abs(residual + epsilon), least)
    return above + below, epsilon * (above - below) / (above + below)


def _sums(keys: Sequence[str], epsilon: float, least: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for record in part.to_dict("records"):
                p, h = record["_p"], record["_h"]
                x = np.asarray(record["_x"], float).reshape(-1, p)
                x = np.hstack([np.ones((len(x), 1)), x])
                y = np.asarray(record["_y"], float).reshape(-1, h)
                theta = record["_theta"]
                theta = np.zeros((h, p + 1)) if theta is None else np.stack([np.asarray(t) for t in theta])
                residual = y - x @ theta.T
                weight, shift = weights_of(residual, epsilon, least)
                loss = np.maximum(np.abs(residual) - epsilon, 0.0).sum(axis=0)
                for j in range(h):
                    heavy = x * weight[:, j:j + 1]
                    sums = np.concatenate([(heavy.T @ x).ravel(), heavy.T @ (y - shift)[:, j], loss[j:j + 1]])
                    rows.append([*(record[k] for k in keys), j + 1, sums, theta[j]])
            yield pd.DataFrame(rows, columns=[*keys, "horizon", "_s", "theta"])

    return run


def _solve(keys: Sequence[str], penalty: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for record in part.to_dict("records"):
                theta, sums = np.asarray(record["theta"]), np.asarray(record["_s"])
                n = len(theta)
                gram, cross = sums[: n * n].reshape(n, n), sums[n * n: -1]
                ridge = np.diag(np.r_[0.0, np.full(n - 1, 1.0 / penalty)])
                value = 0.5 * theta[1:] @ theta[1:] + penalty * sums[-1]
                rows.append([*(record[k] for k in keys), record["horizon"], np.linalg.solve(gram + ridge, cross), value])
            yield pd.DataFrame(rows, columns=[*keys, "horizon", "theta", "objective"])

    return run


def fit_insensitive(train: DataFrame, keys: Sequence[str] = ("clust_id",), penalty: float = 1.0, epsilon: float = 0.1,
                    rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """One model per group and horizon: keys, horizon (1-based), intercept, coef.

    Minimises |coef|^2 / 2 + penalty * sum of max(|residual| - epsilon, 0); the intercept is free. Rounds end when no model's
    objective falls by more than ``tolerance`` of itself. Parabolas are at most as steep as at a distance of ``epsilon`` / 10
    (or 1e-3), so the objective ends at most penalty * samples * that distance above the least one. No samples, no models.
    """
    if penalty <= 0 or epsilon < 0:
        raise ValueError("the penalty must be positive and epsilon not negative")
    keys, least = list(keys), epsilon / 10 or 1e-3
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in train.select(*keys).schema.fields)
    blocks = _packed(train, keys)
    models, before = None, None
    for _ in range(rounds):
        if models is None:
            asked = blocks.withColumn("_theta", F.lit(None).cast("array<array<double>>"))
        else:
            ordered = F.transform(F.sort_array(F.collect_list(F.struct("horizon", "theta"))), lambda m: m["theta"])
            asked = blocks.join(models.groupBy(*keys).agg(ordered.alias("_theta")), keys)
        parts = asked.mapInPandas(_sums(keys, epsilon, least), f"{kept}horizon int, _s array<double>, theta array<double>")
        sums = parts.groupBy(*keys, "horizon").agg(
            vector_to_array(Summarizer.sum(array_to_vector("_s"))).alias("_s"), F.first("theta").alias("theta"))
        models = cut_lineage(sums.mapInPandas(_solve(keys, penalty), f"{kept}horizon int, theta array<double>, objective double"))
        if before is not None:
            old = before.withColumnRenamed("objective", "_old").drop("theta")
            fall = (F.col("_old") - F.col("objective")) / F.greatest(F.col("_old"), F.lit(1e-12))
            if not ((models.join(old, [*keys, "horizon"]).agg(F.max(fall)).first()[0] or 0.0) > tolerance):
                break
        before = models
    return models.select(*keys, "horizon", F.col("theta")[0].alias("intercept"),
                         F.slice("theta", 2, F.greatest(F.size("theta") - 1, F.lit(0))).alias("coef"))
