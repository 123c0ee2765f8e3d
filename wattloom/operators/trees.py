"""Boosted regression trees for many groups at once: one model per cluster and horizon, all from one job.

A cluster has one sample per training base, so a model's samples are bounded by the time grid, however many readings there
are. The features of a cluster are binned once; the binned table (a byte a value) goes to one task per horizon, which adds
up gradients by node, feature and bin, level by level. Models are rows: trees as heaps, to be stored and applied later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, at most; a feature with fewer different values is split between any two of them.
BINS = 256
#: Values of the binned table that are added up at once.
SLAB = 1 << 20
#: A split has to lower the loss by more than this.
LEAST_GAIN = 1e-6


def cut_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Middles between neighbouring values; of more than ``bins`` different values between evenly spaced quantiles."""
    known = np.unique(values)
    if len(known) > bins:
        known = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="inverted_cdf"))
    return (known[1:] + known[:-1]) / 2


def best_splits(table: np.ndarray, gradient: np.ndarray, node: np.ndarray, nodes: int, bins: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and last bin on the left of the best split of each node; of equal gains the first feature and bin.

    ``table`` holds a row of bins for each feature; samples with a negative node take no part.
    """
    live = np.flatnonzero(node >= 0)
    place, slope = node[live], gradient[live]
    total, count = np.bincount(place, slope, nodes), np.bincount(place, minlength=nodes)
    before = total**2 / (count + penalty)
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
    step = max(1, SLAB // max(len(live), 1))
    for first in range(0, len(table), step):
        part = table[first:first + step, live]
        key = ((np.arange(len(part))[:, None] * nodes + place) * bins + part).ravel()
        shape = (len(part), nodes, bins)
        left = np.bincount(key, np.broadcast_to(slope, part.shape).ravel(), len(part) * nodes * bins).reshape(shape).cumsum(axis=2)
        held = np.bincount(key, minlength=len(part) * nodes * bins).reshape(shape).cumsum(axis=2)
        rest, others = total[:, None] - left, count[:, None] - held
        made = left**2 / (held + penalty) + rest**2 / (others + penalty) - before[:, None]
        made[(held < 1) | (others < 1)] = -np.inf
        flat = made.transpose(1, 0, 2).reshape(nodes, -1)
        at = flat.argmax(axis=1)
        found = flat[np.arange(nodes), at]
        better = found > gain
        gain[better], feature[better], cut[better] = found[better], first + at[better] // bins, at[better] % bins
    feature[gain <= LEAST_GAIN] = -1
    return gain, feature, cut


def grow(table: np.ndarray, goal: np.ndarray, rounds: int, depth: int, rate: float, penalty: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Start value and, for each tree, feature (-1: leaf), last bin on the left and value of each node of a heap."""
    bins = int(table.max(initial=0)) + 1
    size = (2 << depth) - 1
    features, cuts, leaves = np.full((rounds, size), -1), np.zeros((rounds, size), np.int64), np.zeros((rounds, size))
    start = float(goal.mean())
    made = np.full(len(goal), start)
    for tree in range(rounds):
        heap, slope = np.zeros(len(goal), np.int64), made - goal
        for level in range(depth):
            base = (1 << level) - 1
            _, feature, cut = best_splits(table, slope, np.where(heap >= base, heap - base, -1), 1 << level, bins, penalty)
            features[tree, base:2 * base + 1], cuts[tree, base:2 * base + 1] = feature, cut
            split = np.flatnonzero((heap >= base) & (features[tree, heap] >= 0))
            heap[split] = 2 * heap[split] + 1 + (table[features[tree, heap[split]], split] > cuts[tree, heap[split]])
        total, count = np.bincount(heap, slope, size), np.bincount(heap, minlength=size)
        leaves[tree] = -rate * total / (count + penalty)
        made += leaves[tree, heap]
    return start, features, cuts, leaves


def fit_trees(train: DataFrame, keys: Sequence[str] = ("clust_id",), rounds: int = 100, depth: int = 6, rate: float = 0.3,
              penalty: float = 1.0, bins: int = BINS) -> DataFrame:
    """Boosted trees per cluster and horizon: keys, horizon, depth, start, and by tree and node feature, cut and leaf.

    Squared error; ``penalty`` is added to the number of samples of a leaf. A sample goes right where its feature exceeds
    the cut. ``bins`` is at most 256.
    """
    if not 2 <= bins <= 256:
        raise ValueError(f"between 2 and 256 bins, got {bins}")
    keys, kinds = list(keys), {f.name: f.dataType.simpleString() for f in train.schema.fields}
    kept = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("base_pos", kind="stable")
        x, y = np.stack(rows["features"]), np.stack(rows["targets"])
        cuts = [cut_points(c, bins) for c in x.T]
        table = np.array([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], np.uint8).reshape(x.shape[1], len(x)).tobytes()
        head = [rows[k].iloc[0] for k in keys]
        return pd.DataFrame([[*head, h + 1, len(x), table, [c.tolist() for c in cuts], y[:, h].tolist()] for h in range(y.shape[1])],
                            columns=[*keys, "horizon", "n", "bins", "cuts", "y"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for record in part.to_dict("records"):
                table = np.frombuffer(record["bins"], np.uint8).reshape(-1, record["n"])
                start, features, cuts, leaves = grow(table, np.asarray(record["y"], float), rounds, depth, rate, penalty)
                held = record["cuts"]
                values = [float(held[f][c]) if f >= 0 else 0.0 for f, c in zip(features.ravel().tolist(), cuts.ravel().tolist(), strict=True)]
                yield pd.DataFrame([[*(record[k] for k in keys), record["horizon"], depth, start, features.ravel().tolist(), values, leaves.ravel().tolist()]],
                                   columns=[*keys, "horizon", "depth", "start", "feature", "cut", "leaf"])

    rows = train.select(*keys, "base_pos", F.col("features").cast("array<double>").alias("features"), F.col("targets").cast("array<double>").alias("targets"))
    packed = rows.groupBy(*keys).applyInPandas(pack, f"{kept}, horizon int, n int, bins binary, cuts array<array<double>>, y array<double>")
    models = f"{kept}, horizon int, depth int, start double, feature array<int>, cut array<double>, leaf array<double>"
    parts = max(train.sparkSession.sparkContext.defaultParallelism, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return packed.repartition(parts, *keys, "horizon").mapInPandas(run, models)  # a fixed number: the rows are few and the work is long


def tree_values(x: np.ndarray, depth: int, start: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Forecast of each row of ``x``; trees come as one flat heap after the other."""
    size = (2 << depth) - 1
    out = np.full(len(x), start)
    rows = np.arange(len(x))
    for begin in range(0, len(feature), size):
        at = np.full(len(x), begin)
        for _ in range(depth):
            down = feature[at] >= 0
            step = 2 * (at - begin) + 1 + (x[rows, np.maximum(feature[at], 0)] > cut[at])
            at = np.where(down, begin + step, at)
        out += leaf[at]
    return out


def predict_trees(models: DataFrame, test: DataFrame, keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """A forecast per base and horizon: keys, base_pos, horizon, pos, pred_val."""
    keys, kinds = list(keys), {f.name: f.dataType.simpleString() for f in test.schema.fields}

    def run(trees: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "base_pos", "horizon", "pos", "pred_val"]
        if not len(trees) or not len(rows):
            return pd.DataFrame(columns=names)
        x, base = np.stack(rows["features"]), rows["base_pos"].to_numpy()
        parts = []
        for r in trees.itertuples(index=False):
            made = tree_values(x, r.depth, r.start, np.asarray(r.feature), np.asarray(r.cut), np.asarray(r.leaf))
            parts.append(pd.DataFrame({**{k: rows[k].to_numpy() for k in keys}, "base_pos": base, "horizon": r.horizon, "pos": base + r.horizon, "pred_val": made}))
        return pd.concat(parts)[names]

    kept = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    asked = test.select(*[F.col(k).alias(k) for k in keys], "base_pos", F.col("features").cast("array<double>").alias("features"))
    return models.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, f"{kept}, base_pos long, horizon int, pos long, pred_val double")
