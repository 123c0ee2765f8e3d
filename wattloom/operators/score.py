"""Forecast errors at the levels of a run, an epoch and a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("mape", "rmse", "nmae", "nrmse")


def error_terms(act: str = "act_val", pred: str = "pred_val") -> dict[str, Column]:
    """Absolute, squared and relative error, and size and square of the actual; a zero actual has no ape."""
    actual, error = F.col(act), F.col(act) - F.col(pred)
    return {
        "ae": F.abs(error),
        "se": error * error,
        "ar": F.abs(actual),
        "sr": actual * actual,
        "ape": F.try_divide(F.abs(error), actual),
    }


def sum_clusters(forecasts: DataFrame, keys: Sequence[str] = ("time",)) -> DataFrame:
    """Actual and forecast added over the clusters."""
    return forecasts.groupBy(*keys).agg(F.sum("act_val").alias("act_val"), F.sum("pred_val").alias("pred_val"))


def forecast_errors(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAPE in percent, RMSE, NMAE and NRMSE over the rows of each key."""
    rmse = F.sqrt(F.avg("se"))
    return df.withColumns(error_terms()).groupBy(*keys).agg(
        (F.avg("ape") * 100).alias("mape"),
        rmse.alias("rmse"),
        F.try_divide(F.avg("ae"), F.avg("ar")).alias("nmae"),
        F.try_divide(rmse, F.sqrt(F.avg("sr"))).alias("nrmse"),
    )


def batch_errors(forecasts: DataFrame) -> DataFrame:
    """Errors per epoch and batch after adding the clusters at each position."""
    return forecast_errors(sum_clusters(forecasts, ("epoch", "batch", "pos")), ("epoch", "batch"))


def epoch_errors(forecasts: DataFrame) -> DataFrame:
    """Mean over the batches of each epoch of the batch errors."""
    return batch_errors(forecasts).groupBy("epoch").agg(*[F.avg(m).alias(m) for m in METRICS])


def train_errors(forecasts: DataFrame, order: str = "pos") -> DataFrame:
    """Training error per epoch: one value per batch and cluster, added over clusters, averaged over batches."""
    once = forecasts.groupBy("epoch", "batch", "clust_id").agg(F.min_by("err_train", order).alias("err_train"))
    batches = once.groupBy("epoch", "batch").agg(F.sum("err_train").alias("err_train"))
    return batches.groupBy("epoch").agg(F.avg("err_train").alias("err_train"))


def error_table(forecasts: DataFrame) -> DataFrame:
    """Training and test errors of each epoch side by side."""
    return train_errors(forecasts).join(epoch_errors(forecasts), "epoch")


def evaluated(metrics: DataFrame, every: int = 10) -> DataFrame:
    """Rows of the batches at which a model is evaluated."""
    return metrics.where(F.col("batch") % every == 0)


def best_checkpoint(errors: DataFrame, every: int = 10) -> DataFrame:
    """Epoch and batch with the lowest MAPE among the evaluated batches; of equal ones the earliest."""
    rank = F.struct("mape", "epoch", "batch")
    best = evaluated(errors, every).where(F.col("mape").isNotNull()).agg(F.min(rank).alias("b"))
    return best.select("b.epoch", "b.batch", "b.mape")
