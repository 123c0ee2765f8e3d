"""Direct multi-horizon forecasts: a model per cluster and horizon, fitted on training bases.

Samples have the columns of ``keys``, ``base_pos``, ``features`` and ``targets`` (one entry per horizon).
Forecasts have ``keys``, ``base_pos``, ``horizon``, ``pos`` and ``pred_val``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.operators.insensitive import fit_insensitive
from wattloom.operators.regress import fit_least_squares, linear_value
from wattloom.operators.trees import fit_trees, predict_trees
from wattloom.operators.windows import dot, sequence_window


def supervised(series: DataFrame, bases: DataFrame, next_times: int, time_features: Sequence[str] = (),
               keys: Sequence[str] = ("clust_id",), value: str = "value") -> DataFrame:
    """Features: the cluster total at the base, then the time variables there. Targets: the next totals.

    Time variables are columns of the series and never enter the targets.
    """
    features = F.array(F.col(value).cast("double"), *[F.col(c).cast("double") for c in time_features])
    rows = sequence_window(series.withColumn("features", features), 1, next_times, keys, (value,))
    samples = rows.select(*keys, F.col("pos").alias("base_pos"), "features", F.col(f"{value}_next").alias("targets"))
    return on_bases(samples, bases)


def meter_samples(series: DataFrame, clusters: DataFrame, samples: DataFrame, key: str = "meter_id", value: str = "value") -> DataFrame:
    """``samples`` whose features are the values of every meter of the cluster at the base, by meter, and then their own.

    For models that need all features in a row; ``forecast_meters`` fits the linear one without. Meters without values are
    left out; a meter with gaps at the bases fails, since its places would shift.
    """
    known = series.where(F.col(value).isNotNull()).join(clusters.select(key, "clust_id"), key)
    counts = known.select("clust_id", key).distinct().groupBy("clust_id").agg(F.count("*").alias("_all"))
    wanted = samples.select("clust_id", F.col("base_pos").alias("pos")).distinct()
    step = F.struct(key, F.col(value).cast("double").alias("v"))
    rows = known.join(wanted, ["clust_id", "pos"], "left_semi").groupBy("clust_id", "pos").agg(
        F.transform(F.sort_array(F.collect_list(step)), lambda s: s["v"]).alias("_values"))
    whole = F.when(F.size("_values") == F.col("_all"), F.col("_values")).otherwise(
        F.raise_error(F.concat(F.lit("meters without value at "), F.col("pos").cast("string"))).cast("array<double>"))
    checked = rows.join(counts, "clust_id").select("clust_id", F.col("pos").alias("base_pos"), whole.alias("_values"))
    joined = samples.join(checked, ["clust_id", "base_pos"])
    return joined.withColumn("features", F.concat("_values", "features")).select(*samples.columns)


def window_samples(series: DataFrame, bases: DataFrame, prev_times: int, next_times: int, log: bool = True,
                   keys: Sequence[str] = ("clust_id",), value: str = "value") -> DataFrame:
    """Features: the last prev_times totals, as log(v + 1) if asked. Targets: the next totals."""
    rows = sequence_window(series, prev_times, next_times, keys, (value,))
    past = F.col(f"{value}_prev")
    features = F.transform(past, lambda v: F.log1p(v)) if log else past
    samples = rows.select(*keys, F.col("pos").alias("base_pos"), features.alias("features"),
                          F.col(f"{value}_next").alias("targets"))
    return on_bases(samples, bases)


def on_bases(samples: DataFrame, bases: DataFrame) -> DataFrame:
    """Samples of the given bases; a base drawn twice counts twice."""
    kept = [c for c in bases.columns if c in ("role",)]
    return samples.join(bases.select(F.col("pos").alias("base_pos"), *kept), "base_pos")


def fit_linear(train: DataFrame, keys: Sequence[str] = ("clust_id",), ridge: float = 0.0) -> DataFrame:
    return fit_least_squares(train, keys, ridge=ridge)


def ar_highway(train: DataFrame, keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """Linear model on the lags in ``features``: 24 log values of the channel."""
    return fit_least_squares(train, keys)


def trend_basis(length: int, k: int) -> np.ndarray:
    """Matrix that turns a window into its trend followed by its seasonal part, edges repeated."""
    half = (k - 1) // 2
    smooth = np.zeros((length, length))
    for i in range(length):
        for j in range(i - half, i + half + 1):
            smooth[i, min(max(j, 0), length - 1)] += 1.0 / k
    return np.vstack([smooth, np.eye(length) - smooth])


def decomposed_linear(train: DataFrame, length: int, k: int = 11, ridge: float = 1.0,
                      keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """Linear model on trend and seasonal lags of the window in ``features``.

    Both parts are linear in the window, so the sums are taken over the plain window, half as wide, and
    turned when solving. Together the parts span only ``length`` dimensions: ridge makes the split matter.
    """
    if k % 2 == 0:
        raise ValueError(f"the kernel length must be odd, got {k}")
    return fit_least_squares(train, keys, ridge=ridge, basis=trend_basis(length, k))


def predict_direct(models: DataFrame, test: DataFrame, keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """A forecast per base and horizon from linear models."""
    value = linear_value(F.col("features"), F.col("intercept"), F.col("coef"))
    return test.select(*keys, "base_pos", "features").join(models, list(keys)).select(
        *keys, "base_pos", "horizon", (F.col("base_pos") + F.col("horizon")).alias("pos"), value.alias("pred_val"))


def persistence_pairs(series: DataFrame, bases: DataFrame, next_times: int, keys: Sequence[str] = ("clust_id",),
                      value: str = "value") -> DataFrame:
    """Per base b and horizon h the total at b - next_times + h and at b + h: base_pos, horizon, x, y.

    The series has no gaps, so both totals meet in one window over the series.
    """
    along = W.partitionBy(*keys).orderBy("pos")
    pairs = series.select(*keys, "pos", F.lag(value, next_times).over(along).alias("x"), F.col(value).alias("y"))
    kept = [c for c in bases.columns if c == "role"]
    steps = bases.select(
        F.col("pos").alias("base_pos"), F.explode(F.sequence(F.lit(1), F.lit(next_times))).alias("horizon"), *kept)
    steps = steps.withColumn("pos", F.col("base_pos") + F.col("horizon"))
    return pairs.where(F.col("x").isNotNull()).join(steps, "pos")


def persistence_ratio(pairs: DataFrame, keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """Factor per cluster and horizon that maps the total of a day earlier to the target with least squares."""
    return pairs.groupBy(*keys, "horizon").agg(
        F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("ratio"))


def predict_persistence(ratios: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    joined = pairs.join(ratios, [*keys, "horizon"])
    return joined.select(*keys, "base_pos", "horizon", "pos", (F.col("ratio") * F.col("x")).alias("pred_val"))


def even_steps(count: int) -> np.ndarray:
    """Irrational step lengths whose multiples, taken modulo 1, fill a cube of ``count`` dimensions evenly."""
    root = 2.0
    for _ in range(64):
        root = (1.0 + root) ** (1.0 / (count + 1))
    return root ** -np.arange(1.0, count + 1)


def fourier_frequencies(width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed standard-normal directions (count x width) and phases of Fourier features.

    They are spread evenly instead of drawn, so a fit is repeatable without a seed.
    """
    spread = np.mod(0.5 + np.outer(np.arange(1, count + 1), even_steps(2 * width + 1)), 1.0)
    normal = np.sqrt(-2.0 * np.log(spread[:, :width])) * np.cos(2 * math.pi * spread[:, width:-1])
    return normal, 2 * math.pi * spread[:, -1]


def scale_gamma(train: DataFrame, features: str = "features") -> DataFrame:
    """One row ``gamma`` = 1 / (number of features * variance of all feature values)."""
    width = train.agg(F.max(F.size(features)).alias("w")).scalar()
    values = train.select(F.explode(features).alias("x"))
    return values.agg(F.try_divide(F.lit(1.0), width * F.var_pop("x")).alias("gamma"))


def fourier_features(samples: DataFrame, width: int, gamma: Column, count: int = 64) -> DataFrame:
    """Replace ``features`` by cosines whose products approximate the radial kernel exp(-gamma |x - y|^2)."""
    directions, phases = fourier_frequencies(width, count)
    fixed = [(w.tolist(), float(b)) for w, b in zip(directions, phases)]
    waves = samples.sparkSession.createDataFrame([(fixed,)], "w array<struct<d: array<double>, b: double>>").scalar()
    height = math.sqrt(2.0 / count)
    held = samples.withColumns({"_w": waves, "_g": F.sqrt(gamma * 2)})
    cosines = F.transform("_w", lambda w: F.cos(F.col("_g") * dot(F.col("features"), w["d"]) + w["b"]) * height)
    return held.withColumn("features", cosines).drop("_w", "_g")


def fit_rbf(train: DataFrame, keys: Sequence[str] = ("clust_id",), ridge: float = 1.0) -> DataFrame:
    """Radial kernel regression: ridge least squares on Fourier features, all clusters and horizons at once."""
    return fit_least_squares(train, keys, ridge=ridge)


def forecast_kernel(train: DataFrame, test: DataFrame, count: int = 64, keys: Sequence[str] = ("clust_id",),
                    penalty: float = 1.0, epsilon: float = 0.1) -> DataFrame:
    """Radial kernel regression with the insensitive loss on Fourier features, all clusters and horizons at once."""
    width, gamma = train.select(F.max(F.size("features"))).first()[0], scale_gamma(train).scalar()
    train, test = (fourier_features(part, width, gamma, count) for part in (train, test))
    return predict_direct(fit_insensitive(train, keys, penalty, epsilon), test, keys)


def _each_model(train: DataFrame, test: DataFrame, next_times: int, keys: Sequence[str], fit, parallelism: int) -> DataFrame:
    """Fit one estimator per cluster and horizon on a shared cached table, predict the test bases, stack.

    Each fit is a distributed job; ``parallelism`` of them run at the same time to fill the cluster.
    """
    spark = train.sparkSession
    train = train.withColumn("_v", array_to_vector("features")).persist(StorageLevel.MEMORY_AND_DISK)
    test = test.withColumn("_v", array_to_vector("features"))
    groups = [row.asDict() for row in train.select(*keys).distinct().orderBy(*keys).collect()]

    def run(task: tuple[dict, int]) -> DataFrame:
        group, h = task
        rows, asked = train, test
        for k, v in group.items():
            rows, asked = rows.where(F.col(k) == F.lit(v)), asked.where(F.col(k) == F.lit(v))
        model = fit(rows.withColumn("_y", F.col("targets")[h - 1]))
        return model.transform(asked).select(
            *keys, "base_pos", F.lit(h).alias("horizon"), (F.col("base_pos") + h).alias("pos"),
            F.col("_yhat").alias("pred_val"))

    tasks = [(group, h) for group in groups for h in range(1, next_times + 1)]
    if not tasks:
        raise ValueError("no training samples")
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        parts = pool.map(inheritable_thread_target(spark)(run), tasks)
    train.unpersist()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def forecast_gbt(train: DataFrame, test: DataFrame, keys: Sequence[str] = ("clust_id",), rounds: int = 100,
                 depth: int = 6, rate: float = 0.3) -> DataFrame:
    """Boosted trees, one model per cluster and horizon, fitted by one job for all of them."""
    return predict_trees(fit_trees(train, keys, rounds, depth, rate), test, keys)


def forecast_huber(train: DataFrame, test: DataFrame, next_times: int, keys: Sequence[str] = ("clust_id",),
                   reg: float = 0.0, max_iter: int = 100, parallelism: int = 4) -> DataFrame:
    """Robust linear models on the given features, for example Fourier features, one per cluster and horizon."""
    estimator = LinearRegression(featuresCol="_v", labelCol="_y", predictionCol="_yhat", loss="huber",
                                 solver="l-bfgs", regParam=reg, maxIter=max_iter)
    return _each_model(train, test, next_times, keys, estimator.fit, parallelism)
