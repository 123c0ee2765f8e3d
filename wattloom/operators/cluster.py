"""Groups of meters by load profile."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.operators.reduce import apply_components, fit_components

# Rows of a partition when the order of rows must not matter, about.
PART_ROWS = 1 << 17


def profiles(series: DataFrame, train: DataFrame, key: str = "meter_id", value: str = "value") -> DataFrame:
    """Per meter the array of log(value + 1) over the training positions, in position order.

    A profile is as long as the training period, whatever the number of meters. Meters without any value have none and
    are left out; ``meters_without_values`` lists them.
    """
    rows = series.where(F.col(value).isNotNull()).join(train.select("pos"), "pos", "left_semi")
    step = F.struct("pos", F.log1p(value).alias("v"))
    return rows.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(step)), lambda s: s["v"]).alias("profile"))


def meters_without_values(series: DataFrame, key: str = "meter_id", value: str = "value") -> DataFrame:
    """Meters that no profile, cluster or forecast can include."""
    return series.groupBy(key).agg(F.count(value).alias("_n")).where("_n = 0").select(key)


def reduce_pca(vectors: DataFrame, k: int = 2, column: str = "profile", out: str = "reduced") -> DataFrame:
    """Coordinates on the first k principal components of these very vectors; see ``reduce`` for models to keep.

    Each component is turned so that its largest loading is positive. Components that the vectors do not span are 0.
    """
    return apply_components(vectors, fit_components(vectors, k, column), column, out)


def relabel(labelled: DataFrame, key: str = "meter_id", label: str = "clust_id") -> DataFrame:
    """Number the labels by the smallest meter they contain; one row per label is ordered."""
    firsts = labelled.groupBy(label).agg(F.min(key).alias("_first"))
    numbered = firsts.withColumn("_new", F.row_number().over(W.orderBy("_first")) - 1)
    return labelled.join(numbered.drop("_first"), label).withColumn(label, F.col("_new")).drop("_new")


def cluster_kmeans(features: DataFrame, k: int, seed: int = 0, key: str = "meter_id", column: str = "reduced",
                   max_iter: int = 50) -> DataFrame:
    """k-means labels: key, clust_id.

    The starting centres depend on how rows are dealt; rows are therefore dealt by their key first, into as many
    partitions as their number asks for, so that the labels do not depend on the partitioning of the input.
    """
    parts = 1 + features.count() // PART_ROWS
    rows = features.select(key, array_to_vector(column).alias("_v")).repartition(parts, key).sortWithinPartitions(key)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="clust_id").fit(rows)
    return relabel(model.transform(rows).select(key, "clust_id"), key)
