import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.operators.fourier import BAND, banded_correlation, grid_sides
from wattloom.operators.spectrum import (
    autocorrelation, delay_aggregate, lag_correlation, roll, softmax, top_count, top_lags)


def circular(a, b):
    n = len(a)
    b = np.r_[b[:n], np.zeros(max(0, n - len(b)))]
    return np.array([sum(a[(i + t) % n] * b[i] for i in range(n)) for t in range(n)])


def test_circular_correlation(spark):
    rng = np.random.default_rng(0)
    pairs = [([1.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 1.0]), (rng.normal(size=9).tolist(), rng.normal(size=9).tolist()),
             ([1.0, 2.0, 3.0, 4.0], [1.0, 1.0]), ([1.0, 2.0], [3.0, 4.0, 5.0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    got = df.withColumn("c", autocorrelation(F.col("a"), F.col("b"))).orderBy("i").collect()
    np.testing.assert_allclose(got[0].c, [2, 1, 0, 1], atol=1e-12)
    for r in got:
        np.testing.assert_allclose(r.c, circular(r.a, r.b), atol=1e-9)
    np.testing.assert_allclose(got[1].c[0], np.dot(*pairs[1]), atol=1e-9)


@pytest.mark.parametrize("length,max_lag,block", [(50, 10, 10), (50, 49, 8), (50, 49, 64), (37, 12, 16), (37, 5, 4096), (40, 20, 20), (9, 8, 2)])
def test_lag_correlation_in_blocks(spark, length, max_lag, block):
    rng = np.random.default_rng(length)
    data, want = [], {}
    for s in range(2):
        a, b = rng.normal(size=length), rng.normal(size=length)
        data += [(s, i, float(a[i]), float(b[i])) for i in range(length)]
        want[s] = circular(a, b)[: max_lag + 1]
    df = spark.createDataFrame(data, "series_id int, pos long, a double, b double")
    got = lag_correlation(df, max_lag, F.lit(length), block=block).toPandas()
    for s in want:
        mine = got[got.series_id == s].sort_values("lag")
        assert mine.lag.tolist() == list(range(max_lag + 1))
        np.testing.assert_allclose(mine["corr"], want[s], atol=1e-9)


@pytest.mark.parametrize("length,max_lag", [(1, 0), (50, 49), (700, 300), (3000, 2999)])
def test_banded_correlation(spark, length, max_lag):
    """Against a transform of the whole series; gaps and nulls are zeros, one series is all null."""
    rng = np.random.default_rng(length)
    data, want = [], {}
    for name in ("x", None):
        a, b = rng.normal(size=length), rng.normal(size=length)
        gap, null = rng.random(length) < 0.2, rng.random(length) < 0.1
        data += [(name, i, None if null[i] else float(a[i]), float(b[i])) for i in range(length) if not gap[i]]
        a[gap | null], b[gap] = 0, 0
        if not gap.all():
            want[name] = np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), n=length)[: max_lag + 1]
    data += [("empty", 0, None, None)]
    want["empty"] = np.zeros(max_lag + 1)
    df = spark.createDataFrame(data, "name string, pos long, a double, b double")
    got = {}
    for r in banded_correlation(df, max_lag, length, ["name"]).collect():
        got.setdefault(r.name, {})[r.lag] = r["corr"]
    assert got.keys() == want.keys()
    for name, lags in got.items():
        assert sorted(lags) == list(range(max_lag + 1))
        np.testing.assert_allclose([lags[i] for i in range(max_lag + 1)], want[name], atol=1e-9)


def test_long_lags_take_the_bands(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=26_000), rng.normal(size=26_000)
    df = spark.createDataFrame(pd.DataFrame({"series_id": 0, "pos": np.arange(26_000), "a": a, "b": b}))
    got = lag_correlation(df, 25_999, F.lit(26_000)).orderBy("lag").toPandas()["corr"]
    np.testing.assert_allclose(got, np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), n=26_000), atol=1e-7)
    rows, cols = grid_sides(2 * 26_000)
    assert rows * cols < 4 * 26_000 and max(rows, cols) * BAND < 26_000


def test_nulls_count_as_zero(spark):
    df = spark.createDataFrame([(0, i, v, v) for i, v in enumerate([1.0, 2.0, None, 4.0])], "series_id int, pos long, a double, b double")
    got = lag_correlation(df, 3, F.lit(4)).orderBy("lag")
    assert [r["corr"] for r in got.collect()] == circular([1.0, 2.0, 0.0, 4.0], [1.0, 2.0, 0.0, 4.0]).tolist()


def test_top_lags_softmax_roll(spark):
    df = spark.createDataFrame([([1.0, 5.0, 3.0, 5.0],)], "c array<double>")
    got = df.select(top_lags(F.col("c"), 3).alias("t"), softmax(F.col("c")).alias("s"), roll(F.col("c"), F.lit(1)).alias("r"),
                    roll(F.col("c"), F.lit(0)).alias("z")).first()
    assert [e.lag for e in got.t] == [1, 3, 2]
    e = np.exp(np.array([1, 5, 3, 5.0]) - 5)
    np.testing.assert_allclose(got.s, e / e.sum())
    assert got.r == [5, 3, 5, 1] and got.z == [1, 5, 3, 5]
    assert top_count(192) == 5 and top_count(192, 3) == 15


@pytest.mark.parametrize("scope", ["batch", "series", "channel"])
def test_delay_aggregate(spark, scope):
    rng = np.random.default_rng(3)
    length, k = 12, top_count(12)
    values = {(b, c): rng.normal(size=length) for b in range(3) for c in range(2)}
    corr = {key: circular(v, v[::-1]) for key, v in values.items()}
    data = [(b, c, v.tolist(), corr[(b, c)].tolist()) for (b, c), v in values.items()]
    df = spark.createDataFrame(data, "base_pos int, clust_id int, values array<double>, corr array<double>")
    got = {(r.base_pos, r.clust_id): r.delayed for r in delay_aggregate(df, length, scope).collect()}
    per_base = {b: (corr[(b, 0)] + corr[(b, 1)]) / 2 for b in range(3)}
    for (b, c), v in values.items():
        own = corr[(b, c)] if scope == "channel" else per_base[b]
        chooser = sum(per_base.values()) / 3 if scope == "batch" else own
        lags = np.argsort(-chooser, kind="stable")[:k]
        w = np.exp(own[lags] - own[lags].max())
        w /= w.sum()
        want = sum(wi * np.roll(v, -g) for wi, g in zip(w, lags))
        np.testing.assert_allclose(got[(b, c)], want, atol=1e-9)
    with pytest.raises(ValueError):
        delay_aggregate(df, length, "other")
