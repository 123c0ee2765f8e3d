"""Circular correlation of long series at many lags: a Fourier transform cut into bands, so that no task holds a series.

A transform of N = rows x columns values is one of the columns, a turn of every value by its place, and one of the rows. Three
shuffles carry each value once: the columns of both series, the rows (both transforms, their product and the way back in one
group), and the columns of the result. A group holds ``BAND`` columns or rows, some sixteen times the root of N.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 16


def grid_sides(size: int) -> tuple[int, int]:
    """Two powers of two, multiples of BAND and as equal as can be, whose product is at least ``size``."""
    bits = max(2 * int(math.log2(BAND)), math.ceil(math.log2(max(size, 1))))
    return 1 << bits // 2, 1 << bits - bits // 2


def _turn(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    return np.exp(-2j * np.pi * (np.outer(i, j) % size) / size)


def _tiles(key: dict, here: int, values: np.ndarray) -> pd.DataFrame:
    """One row per BAND columns of ``values`` (parts, BAND, n): where they go, where they come from, and the numbers."""
    parts = np.split(values, values.shape[-1] // BAND, axis=-1)
    flat = [np.stack([p.real, p.imag]).ravel() for p in parts]
    return pd.DataFrame({**key, "_to": np.arange(len(parts)), "_from": here, "_v": flat})


def _untile(rows: pd.DataFrame, parts: int) -> np.ndarray:
    """Array (parts, n, BAND) of the tiles that meet in a band, n running over the bands they come from."""
    tiles = [np.asarray(v).reshape(2, parts, BAND, BAND) for v in rows.sort_values("_from")["_v"]]
    both = np.concatenate(tiles, axis=2)
    return both[0] + 1j * both[1]


def _steps(keys: Sequence[str], rows: int, cols: int, max_lag: int) -> tuple[Callable, Callable, Callable]:
    size = rows * cols

    def start(group: pd.DataFrame) -> pd.DataFrame:
        """Transform of the columns of both series."""
        band = int(group["_to"].iloc[0])
        own = np.arange(band * BAND, (band + 1) * BAND)
        x = np.zeros((2, BAND, rows))
        for part, name in enumerate(("_a", "_b")):
            known = group[group[name].notna()]
            at = known["_at"].to_numpy(np.int64)
            x[part, at % cols - own[0], at // cols] = known[name]
        return _tiles({k: group[k].iloc[0] for k in keys}, band, np.fft.fft(x) * _turn(own, np.arange(rows), size))

    def middle(group: pd.DataFrame) -> pd.DataFrame:
        """Transform of the rows, product of the series, and the way back."""
        band = int(group["_to"].iloc[0])
        own = np.arange(band * BAND, (band + 1) * BAND)
        a, b = np.fft.fft(_untile(group, 2), axis=1)
        back = np.fft.ifft(a * np.conj(b), axis=0).T * np.conj(_turn(own, np.arange(cols), size))
        return _tiles({k: group[k].iloc[0] for k in keys}, band, back[None])

    def end(group: pd.DataFrame) -> pd.DataFrame:
        """The way back of the columns: lags and correlations."""
        band = int(group["_to"].iloc[0])
        values = np.fft.ifft(_untile(group, 1)[0], axis=0).real
        lag = np.arange(rows)[:, None] * cols + np.arange(band * BAND, (band + 1) * BAND)
        wanted = lag <= max_lag
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, "lag": lag[wanted], "corr": values[wanted]})

    return start, middle, end


def banded_correlation(series: DataFrame, max_lag: int, length: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Sum over i of a[(i + lag) mod length] * b[i] for lags 0..max_lag: keys, lag, corr.

    Columns ``a`` and ``b`` at positions 0..length-1, max_lag below the length; a null or missing value counts as 0. Time grows
    like N log N with N = length + max_lag, whatever the number of lags.
    """
    rows, cols = grid_sides(length + max_lag)
    ends = F.explode(F.array(F.col("pos"), F.col("pos") + length))
    turned = series.select(*keys, "a", ends.alias("_at")).where(F.col("_at") < length + max_lag)

    def value(c: str) -> Column:
        return F.col(c).cast("double") if c in ("a", "b") else F.lit(None).cast("double")

    ahead = turned.select(*keys, F.col("_at").cast("long").alias("_at"), value("a").alias("_a"), value("").alias("_b"))
    own = series.select(*keys, F.col("pos").cast("long").alias("_at"), value("").alias("_a"), value("b").alias("_b"))
    both = ahead.unionByName(own).where(F.coalesce("_a", "_b").isNotNull())
    both = both.withColumn("_to", F.floor(F.col("_at") % cols / BAND).cast("long"))
    types = dict(series.dtypes)
    named = "".join(f"`{k}` {types[k]}, " for k in keys)
    tiles = named + "_to long, _from long, _v array<double>"
    start, middle, end = _steps(tuple(keys), rows, cols, max_lag)
    # every series has all bands: those without a value come from one row a band
    marks = series.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols // BAND - 1).cast("long"))).alias("_to"))
    blank = marks.select(*keys, F.lit(0).cast("long").alias("_at"), value("").alias("_a"), value("").alias("_b"), "_to")
    done = both.unionByName(blank).groupBy(*keys, "_to").applyInPandas(start, tiles)
    done = done.groupBy(*keys, "_to").applyInPandas(middle, tiles)
    return done.groupBy(*keys, "_to").applyInPandas(end, named + "lag long, corr double")
