"""Runs over a grid of seasons, models and cluster set-ups."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.conf import ForecastConf
from wattloom.functions.calendar import cyclical, weekday_flags
from wattloom.operators import forecast as fc
from wattloom.operators.cluster import cluster_kmeans, profiles, reduce_pca
from wattloom.operators.dbscan import cluster_dbscan
from wattloom.operators.joins import attach_actuals
from wattloom.operators.reduce import apply_feature_axes, fit_feature_axes
from wattloom.operators.score import forecast_errors, sum_clusters
from wattloom.operators.series import cluster_totals, single_cluster
from wattloom.operators.split import Split
from wattloom.operators.wide import forecast_meters
from wattloom.session import cut_lineage
from wattloom.sources.tables import cluster_code, only_missing, run_code, write_run

# Neighbourhood radius of the density clustering per reduction method.
DBSCAN_EPS = {"tsne": 1.0, "umap": 0.25}
DBSCAN_EPS_OTHER = 30.0

MODELS = ("persistence", "linear", "ar", "dlinear", "rbf", "gbt", "svr")
FOURIER_COUNT = 64


@dataclass(frozen=True)
class ClusterSetup:
    n_cluster: int = 1
    method: str | None = None
    reduction: str | None = None
    dims: int | None = None


# The two set-ups that are compared, four k-means groups on two components and no groups.
COMPARED = (ClusterSetup(4, "kmeans", "pca", 2), ClusterSetup())


def experiment_grid(spark: SparkSession, models: Sequence[str], seasons: Sequence[str] = ("summer", "winter"),
                    setups: Sequence[ClusterSetup] = COMPARED, reps: int = 10,
                    feature_dims: Sequence[int | None] = (None,)) -> DataFrame:
    """One row per run: repetition, season, model, cluster set-up and number of components that the model's features are
    reduced to (null: not at all), with its run code."""
    setup = F.array(*[
        F.struct(F.lit(s.n_cluster).alias("n_cluster"), F.lit(s.method).cast("string").alias("method"),
                 F.lit(s.reduction).cast("string").alias("reduction"), F.lit(s.dims).cast("int").alias("dims"))
        for s in setups])
    grid = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.array(*map(F.lit, seasons))).alias("season"))
    grid = grid.select("*", F.explode(F.array(*map(F.lit, models))).alias("model"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(d).cast("int") for d in feature_dims])).alias("feature_dims"))
    grid = grid.select("*", F.explode(setup).alias("_s")).select("rep", "season", "model", "feature_dims", "_s.*")
    clusters = cluster_code(F.col("n_cluster"), F.col("method"), F.col("reduction"), F.col("dims"))
    reduction = F.when(F.col("feature_dims").isNotNull(), "pca")
    code = run_code(F.col("model"), clusters, F.col("season"), reduction, F.col("feature_dims"))
    return grid.withColumn("run_code", code).withColumn("run_id", F.concat_ws("#", "run_code", "rep"))


def find_clusters(series: DataFrame, split: Split, setup: ClusterSetup, seed: int = 0) -> tuple[DataFrame, dict]:
    """Cluster map from the training period, and the seconds spent on reduction and clustering."""
    if setup.n_cluster <= 1:
        return single_cluster(series), {"REDUCE_DIM_CLUSTER": 0.0, "CLUSTERING": 0.0}
    train = split.season.where(F.col("pos") < split.start.scalar())
    vectors, column = cut_lineage(profiles(series, train)), "profile"
    begin = time.time()
    if setup.reduction == "pca":
        vectors, column = cut_lineage(reduce_pca(vectors, setup.dims)), "reduced"
    elif setup.reduction is not None:
        raise ValueError(f"reduction {setup.reduction!r} is not available; use 'pca' or None")
    reduced = time.time()
    if setup.method == "kmeans":
        labels = cluster_kmeans(vectors, setup.n_cluster, seed, column=column)
    elif setup.method == "dbscan":
        if column != "reduced":
            raise ValueError("dbscan needs reduced profiles")
        axes = [f"_a{j}" for j in range(setup.dims)]
        points = vectors.withColumns({a: F.col(column)[j] for j, a in enumerate(axes)})
        labels = cluster_dbscan(points, axes, DBSCAN_EPS.get(setup.reduction, DBSCAN_EPS_OTHER)).drop("core")
    else:
        raise ValueError(f"unknown cluster method {setup.method!r}")
    labels = cut_lineage(labels)
    return labels, {"REDUCE_DIM_CLUSTER": reduced - begin, "CLUSTERING": time.time() - reduced}


def forecast_model(totals: DataFrame, split: Split, model: str, time_features: Sequence[str] = (),
                   feature_dims: int | None = None, seconds: dict | None = None,
                   meters: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Forecasts of one model at the test bases: clust_id, base_pos, horizon, pos, pred_val.

    ``totals`` holds the cluster totals and the time variables named in ``time_features``. With ``feature_dims`` the model
    sees that many principal components of its features, fitted on the training samples of each cluster and applied to
    both parts; ``seconds`` takes the time of the fit. Persistence has no features and dlinear needs its window as it is.
    With ``meters`` (series and cluster map) linear, rbf, svr and gbt see the value of each meter of the cluster at the base
    instead of their total.
    """
    conf, roles = split.conf, split.base_roles()
    if feature_dims is not None and model in ("persistence", "dlinear"):
        raise ValueError(f"the features of {model!r} cannot be reduced")

    def parts(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
        train, test = samples.where("role = 'train'").drop("role"), samples.where("role = 'test'").drop("role")
        if feature_dims is None or "features" not in samples.columns:
            return train, test
        begin = time.time()
        axes = cut_lineage(fit_feature_axes(train, feature_dims))
        if seconds is not None:
            seconds["REDUCE_DIM_FEATURE"] = time.time() - begin
        return apply_feature_axes(train, axes), apply_feature_axes(test, axes)

    if model == "persistence":
        train, test = parts(fc.persistence_pairs(totals, roles, conf.next_times))
        return fc.predict_persistence(fc.persistence_ratio(train), test)
    if model in ("linear", "rbf", "gbt", "svr"):
        samples = fc.supervised(totals, roles, conf.next_times, time_features)
        if meters is not None:
            samples = cut_lineage(samples.withColumn("features", F.slice("features", 2, len(time_features))))
            if model == "linear" and feature_dims is None:
                return forecast_meters(*meters, samples)
            samples = cut_lineage(fc.meter_samples(*meters, samples))
        train, test = parts(samples)
        if model == "linear":
            return fc.predict_direct(fc.fit_linear(train), test)
        if model == "gbt":
            return fc.forecast_gbt(train, test)
        if model == "svr":
            return fc.forecast_kernel(train, test, FOURIER_COUNT)
        gamma, width = fc.scale_gamma(train).scalar(), train.select(F.max(F.size("features"))).first()[0]
        train, test = (fc.fourier_features(p, width, gamma, FOURIER_COUNT) for p in (train, test))
        return fc.predict_direct(fc.fit_rbf(train), test)
    if model == "ar":
        train, test = parts(fc.window_samples(totals, roles, conf.next_times, conf.next_times))
        return fc.predict_direct(fc.ar_highway(train), test)
    if model == "dlinear":
        train, test = parts(fc.window_samples(totals, roles, conf.prev_times, conf.next_times))
        return fc.predict_direct(fc.decomposed_linear(train, conf.prev_times), test)
    raise ValueError(f"model must be one of {MODELS}, got {model!r}")


def with_calendar(totals: DataFrame) -> tuple[DataFrame, list[str]]:
    """Totals with hour cycle and weekday flags as time variables."""
    at = F.col("time")
    cycles = cyclical(at)
    features = {"hour_x": cycles["hour_x"], "hour_y": cycles["hour_y"], **weekday_flags(at)}
    return totals.withColumns(features), list(features)


def run_model(series: DataFrame, index: DataFrame, conf: ForecastConf, model: str, setup: ClusterSetup = ClusterSetup(),
              rep: int = 0, found: tuple[DataFrame, dict] | None = None, feature_dims: int | None = None,
              meter_features: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One run: cluster map, error row, timings and forecasts.

    Repetitions differ in their training sample, not in their clusters; ``found`` hands in clusters that an earlier run
    of the same season and set-up has found, with their seconds. With ``meter_features`` the models that can see the meters
    of a cluster, not only their total.
    """
    spark = series.sparkSession
    split = Split(index, conf, seed=rep)
    clusters, seconds = found or find_clusters(series, split, setup)
    seconds = {**seconds, "REDUCE_DIM_FEATURE": 0.0}
    begin = time.time()
    totals, features = with_calendar(cut_lineage(cluster_totals(series, clusters)))
    meters = (series, clusters) if meter_features else None
    forecasts = cut_lineage(attach_actuals(forecast_model(totals, split, model, features, feature_dims, seconds, meters), totals))
    seconds["LEARNING"] = time.time() - begin - seconds["REDUCE_DIM_FEATURE"]
    errors = forecast_errors(sum_clusters(forecasts))
    timings = spark.createDataFrame(list(seconds.items()), "stage string, seconds double")
    return clusters, errors, timings, forecasts


def run_grid(series: DataFrame, index: DataFrame, settings: DataFrame, root: str,
             conf: ForecastConf = ForecastConf()) -> int:
    """Run all settings that have no metrics below ``root`` yet and append their results; returns their number.

    The loop is over runs, of which there are a few hundred; every run is distributed.
    """
    spark = series.sparkSession
    series = cut_lineage(series)
    try:
        settings = only_missing(settings, spark.read.parquet(f"{root}/metrics"), "run_id")
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    pending = settings.orderBy("season", "n_cluster", "method", "reduction", "dims", "run_id").collect()
    known, found = None, None
    for row in pending:
        setup = ClusterSetup(row["n_cluster"], row["method"], row["reduction"], row["dims"])
        season = replace(conf, season=row["season"])
        if known != (row["season"], setup):  # clusters are found once for all models and repetitions
            known, found = (row["season"], setup), find_clusters(series, Split(index, season), setup)
        parts = run_model(series, index, season, row["model"], setup, int(row["rep"]), found, row["feature_dims"])
        stamp = {"run_id": row["run_id"], "run_code": row["run_code"], "model": row["model"], "season": row["season"],
                 "run_time": time.strftime("%Y%m%d%H%M%S", time.gmtime())}
        clusters, errors, timings, forecasts = parts
        write_run(root, stamp, clusters, errors, timings, forecasts)
    return len(pending)
