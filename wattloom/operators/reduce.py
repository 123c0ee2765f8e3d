"""Principal components as stored models: fitted on some vectors, applied to any.

Long vectors (load profiles) are reduced by a randomised range finder: a pass multiplies the vectors, packed to blocks, by a
few columns and by their transpose, and sums up. Passes add to one search space until the components do not change, or the
space holds all vectors. Many groups of short vectors (features of the models of each cluster) are reduced by the sums of
their products, group by group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.regress import product_sums
from wattloom.operators.windows import dot

#: Columns of a pass beyond the components asked for.
BESIDE = 46
#: Bytes of a packed block, about.
BLOCK = 1 << 21
MODEL = "axes array<array<double>>, mean array<double>, spread array<double>"


@dataclass(frozen=True)
class Components:
    """``axes``: a component a row, ``mean`` of the fitted vectors, ``spread``: variance along each axis."""

    axes: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """One row, to be stored with ``write_table``."""
        return spark.createDataFrame([(self.axes.tolist(), self.mean.tolist(), self.spread.tolist())], MODEL)

    @classmethod
    def of(cls, table: DataFrame) -> Components:
        row = table.first()
        return cls(*[np.array(row[c], float) for c in ("axes", "mean", "spread")])


def _turned(axes: np.ndarray) -> np.ndarray:
    """Axes whose largest loading is positive."""
    return np.array([a if a[abs(a).argmax()] >= 0 else -a for a in axes]).reshape(axes.shape)


def _packed(vectors: DataFrame, column: str, width: int) -> DataFrame:
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, BLOCK // (8 * width))
        for part in parts:
            for begin in range(0, len(part), step):
                yield pd.DataFrame({"matrix": [np.stack(part[column].iloc[begin:begin + step]).astype(float).tobytes()]})

    return vectors.select(F.col(column).cast("array<double>").alias(column)).mapInPandas(pack, "matrix binary")


def _pass(blocks: DataFrame, width: int, columns: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number and sum of the vectors, and their matrix, transposed, times itself times ``columns``; summed up in tasks first.

    What comes to the driver is as long as one vector, and so is what goes out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total, product = 0, np.zeros(width), np.zeros((width, columns.shape[1]))
        for part in parts:
            for blob in part["matrix"]:
                matrix = np.frombuffer(blob).reshape(-1, width)
                count += len(matrix)
                total += matrix.sum(axis=0)
                product += matrix.T @ (matrix @ columns)
        if count:
            yield pd.DataFrame({"part": range(0, width, 1024), "count": count, "held": [np.c_[total, product][a:a + 1024].tobytes() for a in range(0, width, 1024)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        held = sum(np.frombuffer(b) for b in rows["held"])
        return pd.DataFrame([(rows["part"].iloc[0], int(rows["count"].sum()), held.tobytes())], columns=["part", "count", "held"])

    sums = blocks.mapInPandas(run, "part int, count long, held binary").groupBy("part").applyInPandas(add, "part int, count long, held binary")
    rows = sums.orderBy("part").collect()
    if not rows:
        return 0, np.zeros(width), np.zeros((width, columns.shape[1]))
    whole = np.vstack([np.frombuffer(r["held"]).reshape(-1, columns.shape[1] + 1) for r in rows])
    return rows[0]["count"], whole[:, 0], whole[:, 1:]


def fit_components(vectors: DataFrame, k: int = 2, column: str = "profile", passes: int = 12, tolerance: float = 1e-9, seed: int = 0) -> Components:
    """The first ``k`` principal components of an array column without nulls.

    Ends when what the covariance leaves of each component is below ``tolerance`` of the largest variance, when all
    dimensions are searched, or after ``passes``; two passes give the usual randomised estimate. Components that the vectors
    do not span are 0. Vectors of different lengths fail; without vectors the model is empty.
    """
    width = vectors.select(F.max(F.size(column))).first()[0] or 0
    if not width:
        return Components(np.zeros((k, 0)), np.zeros(0), np.zeros(k))
    blocks = _packed(vectors, column, width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _searched(blocks, width, k, passes, tolerance, seed)
    finally:
        blocks.unpersist()


def _searched(blocks: DataFrame, width: int, k: int, passes: int, tolerance: float, seed: int) -> Components:
    near = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, k + BESIDE))))[0]
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(passes):
        count, total, product = _pass(blocks, width, near)
        mean = total / max(count, 1)
        image = product - count * np.outer(mean, mean @ near)
        basis, images = np.hstack([basis, near]), np.hstack([images, image])
        values, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        left = np.sqrt(((images @ turn - basis @ turn * values) ** 2).sum(axis=0)).max(initial=0)
        if left <= tolerance * max(values.max(initial=0), 0) or basis.shape[1] >= width:
            break
        for _ in range(2):  # twice, so that rounding leaves nothing of what is searched already
            image = image - basis @ (basis.T @ image)
        side, size, _ = np.linalg.svd(image, full_matrices=False)
        near = side[:, size > 1e-13 * max(np.abs(values).max(initial=0), 1e-300)][:, :width - basis.shape[1]]
        near = np.linalg.qr(near - basis @ (basis.T @ near))[0]
        if not near.shape[1]:
            break
    axes, spread = np.zeros((k, width)), np.zeros(k)
    spanned = values > 1e-12 * max(values.max(initial=0), 0)
    axes[:len(values)][spanned], spread[:len(values)][spanned] = (basis @ turn).T[spanned], values[spanned] / max(count - 1, 1)
    return Components(_turned(axes), mean, spread)


def _coordinates(vector: Column, axes: Column, mean: Column) -> Column:
    away = F.zip_with(vector, mean, lambda x, m: x - m)
    return F.transform(axes, lambda a: dot(away, a))


def apply_components(vectors: DataFrame, model: Components, column: str = "profile", out: str = "reduced") -> DataFrame:
    """``vectors`` with their coordinates; they need not be the ones that the model was fitted on."""
    held = model.table(vectors.sparkSession)
    parts = vectors.withColumns({"_axes": held.select("axes").scalar(), "_mean": held.select("mean").scalar()})
    return parts.withColumn(out, _coordinates(F.col(column), F.col("_axes"), F.col("_mean"))).drop("_axes", "_mean")


def fit_feature_axes(train: DataFrame, dims: int, keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """Principal components of the features of each cluster's training samples: keys, axes, mean."""
    keys = list(keys)
    rows = train.withColumn("_none", F.array().cast("array<double>"))
    sums = product_sums(rows, keys, "features", "_none")

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for record in part.to_dict("records"):
                width = int(record["width"])
                products = np.asarray(record["sums"]).reshape(width + 1, width + 1)
                mean = products[0, 1:] / products[0, 0]
                values, turn = np.linalg.eigh(products[1:, 1:] - products[0, 0] * np.outer(mean, mean))
                axes = np.zeros((dims, width))
                found = turn.T[::-1][:dims]
                axes[:len(found)] = np.where((values[::-1][:dims] > 1e-12 * max(values[-1], 0))[:, None], found, 0.0)
                out.append([*(record[key] for key in keys), _turned(axes).tolist(), mean.tolist()])
            yield pd.DataFrame(out, columns=[*keys, "axes", "mean"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in train.select(*keys).schema.fields)
    return sums.mapInPandas(solve, f"{kept}, axes array<array<double>>, mean array<double>")


def apply_feature_axes(samples: DataFrame, models: DataFrame, keys: Sequence[str] = ("clust_id",)) -> DataFrame:
    """Samples whose features are their coordinates on the axes of their cluster."""
    joined = samples.join(models, list(keys))
    return joined.withColumn("features", _coordinates(F.col("features"), F.col("axes"), F.col("mean"))).select(*samples.columns)
