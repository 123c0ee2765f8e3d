"""Circular correlation of window arrays, strongest lags and their weighted roll.

Windows have a fixed length L, so all work on one window stays inside its row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.operators.fourier import banded_correlation

SCOPES = ("batch", "series", "channel")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _circular(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        out = []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append(None)
                continue
            n = len(x)
            fit = np.zeros(n)
            fit[: min(n, len(y))] = y[:n]
            product = np.fft.rfft(x) * np.conj(np.fft.rfft(fit))
            out.append(np.fft.irfft(product, n=n))
        yield pd.Series(out)


def autocorrelation(a: Column, b: Column) -> Column:
    """Array over the lag t of sum_i a[(i+t) mod L] * b[i], L the length of a; b is cut or padded with zeros.

    Fourier transform per window: L log L instead of L * L steps, without writing out any pair.
    """
    return _circular(a, b)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _sliding(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([np.correlate(x, y, mode="valid") for x, y in zip(a, b)])


def lag_correlation(series: DataFrame, max_lag: int, length: Column, keys: Sequence[str] = ("series_id",),
                    block: int = 4096) -> DataFrame:
    """Circular correlation of whole series for lags 0..max_lag: keys, lag, corr.

    Columns ``a`` and ``b`` at positions 0..length-1, max_lag below the length; a null counts as 0. The series is cut into blocks
    of b; each block also holds the max_lag values of a that follow it. A block adds up all its lags by itself,
    so a row is shuffled about twice, and one row per block and lag is added afterwards. Lags that reach further than a block
    come from a transform of the whole series, cut into bands.
    """
    if max_lag > block:
        steps = series.sparkSession.range(1).select(length.cast("long")).first()[0]
        return banded_correlation(series, max_lag, steps, keys)
    size = F.lit(block)
    ends = F.explode(F.array(F.col("pos"), F.col("pos") + length))
    turned = series.select(*keys, "a", ends.alias("_e")).where(F.col("_e") < length + max_lag)
    last = F.least(F.floor(F.col("_e") / size), F.floor((length - 1) / size))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_e") - max_lag - block + 1) / size))
    ahead = turned.where(first <= last).withColumn("_blk", F.explode(F.sequence(first, last)))
    reach = F.least((F.col("_blk") + 1) * size, length) - 1 + max_lag
    ahead = ahead.where(F.col("_e") <= reach).select(
        *keys, "_blk", F.col("_e").alias("_at"), F.coalesce(F.col("a").cast("double"), F.lit(0.0)).alias("_a"), F.lit(None).cast("double").alias("_b"))
    own = series.select(*keys, F.floor(F.col("pos") / size).alias("_blk"), F.col("pos").alias("_at"),
                        F.lit(None).cast("double").alias("_a"), F.coalesce(F.col("b").cast("double"), F.lit(0.0)).alias("_b"))
    def ordered(c: str) -> Column:
        present = F.when(F.col(c).isNotNull(), F.struct("_at", c))
        return F.transform(F.sort_array(F.collect_list(present)), lambda s: s[c])

    blocks = ahead.unionByName(own).groupBy(*keys, "_blk").agg(ordered("_a").alias("_a"), ordered("_b").alias("_b"))
    sums = blocks.select(*keys, F.posexplode(_sliding("_a", "_b")).alias("lag", "_c"))
    return sums.groupBy(*keys, "lag").agg(F.sum("_c").alias("corr"))


def top_count(length: int, factor: float = 1.0) -> int:
    return int(factor * math.log(length))


def top_lags(corr: Column, k: int, digits: int = 6) -> Column:
    """The k strongest lags of a correlation array as structs (lag, corr).

    Correlations equal up to ``digits`` places rank by the smaller lag.
    """
    entries = F.transform(corr, lambda c, i: F.struct((-F.round(c, digits)).alias("key"), i.alias("lag"), c.alias("corr")))
    best = F.slice(F.array_sort(entries), 1, k)
    return F.transform(best, lambda e: F.struct(e["lag"].alias("lag"), e["corr"].alias("corr")))


def softmax(values: Column) -> Column:
    """Weights that sum to 1; the largest value is subtracted first."""
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def roll(values: Column, lag: Column) -> Column:
    """Circular shift: element i of the result is element (i + lag) mod L."""
    size = F.size(values)
    start = F.pmod(lag, size)
    return F.concat(F.slice(values, start + 1, size), F.slice(values, F.lit(1), start))


def weighted_roll(values: Column, lags: Column, weights: Column) -> Column:
    """Sum over the lags of weight * rolled values."""
    parts = F.arrays_zip(lags.alias("lag"), weights.alias("weight"))
    zero = F.transform(values, lambda v: F.lit(0.0))
    return F.aggregate(
        parts, zero,
        lambda total, p: F.zip_with(total, roll(values, p["lag"]), lambda s, v: s + v * p["weight"]))


def _mean_corr(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean correlation per lag over the rows of each key; at most L rows per key leave a task."""
    long = df.select(*keys, F.posexplode("corr").alias("lag", "_c"))
    means = long.groupBy(*keys, "lag").agg(F.avg("_c").alias("_c"))
    ordered = F.sort_array(F.collect_list(F.struct("lag", "_c")))
    return means.groupBy(*keys).agg(ordered.alias("_m")).select(
        *keys, F.transform("_m", lambda m: m["_c"]).alias("mean_corr"))


def delay_aggregate(windows: DataFrame, length: int, scope: str = "series", factor: float = 1.0,
                    base: str = "base_pos", values: str = "values", corr: str = "corr", out: str = "delayed",
                    digits: int = 6) -> DataFrame:
    """Roll each window by its strongest lags and add the results with softmax weights.

    One row per base and channel. ``batch``: lags chosen on the mean correlation over all bases and channels,
    weights per base; ``series``: lags and weights per base, from the mean over its channels; ``channel``:
    lags and weights of the row itself.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}, got {scope!r}")
    k = top_count(length, factor)
    rows = windows.withColumnRenamed(corr, "corr") if corr != "corr" else windows
    if scope == "channel":
        chosen = rows.withColumn("_top", top_lags(F.col("corr"), k, digits))
    else:
        means = _mean_corr(rows, [base])
        if scope == "series":
            picked = means.select(base, top_lags(F.col("mean_corr"), k, digits).alias("_top"))
        else:
            shared = _mean_corr(rows, []).select(
                F.transform(top_lags(F.col("mean_corr"), k, digits), lambda e: e["lag"]).alias("lags")).scalar()
            own = F.transform(F.col("_lags"), lambda g: F.struct(
                g.alias("lag"), F.element_at("mean_corr", g + 1).alias("corr")))
            picked = means.withColumn("_lags", shared).select(base, own.alias("_top"))
        chosen = rows.join(picked, base)
    lags = F.transform("_top", lambda e: e["lag"])
    weights = softmax(F.transform("_top", lambda e: e["corr"]))
    return chosen.withColumns({"lags": lags, "weights": weights}).withColumn(
        out, weighted_roll(F.col(values), F.col("lags"), F.col("weights"))).drop("_top")
