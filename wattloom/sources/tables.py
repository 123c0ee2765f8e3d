"""Parquet tables between stages, incremental loads and run results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# In the order in which they are written: a run with metrics is complete.
RUN_TABLES = ("clusters", "timings", "forecasts", "metrics")


def write_table(df: DataFrame, path: str, keys: Sequence[str] = (), mode: str = "overwrite",
                rows_per_file: int = 1 << 22) -> None:
    """Write Parquet, partitioned by low-cardinality keys such as a month, never by meter.

    Each key gets as many tasks and files as its rows need: keys are counted first, and their rows spread by a hash.
    """
    if not keys:
        df.write.mode(mode).parquet(path)
        return
    rest = [c for c in df.columns if c not in keys]
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    same = [F.col(f"_d.{k}").eqNullSafe(F.col(f"_n.{k}")) for k in keys]
    sized = df.alias("_d").join(counts.alias("_n"), same).select("_d.*", "_n._files")
    salt = F.pmod(F.xxhash64(*rest), F.col("_files")) if rest else F.lit(0)
    spread = sized.withColumn("_salt", salt).repartition(*keys, "_salt").drop("_salt", "_files")
    spread.write.mode(mode).partitionBy(*keys).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def only_missing(candidates: DataFrame, existing: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Candidates whose key has not been written yet."""
    key = [key] if isinstance(key, str) else list(key)
    return candidates.join(existing.select(*key).distinct(), key, "left_anti")


def append_missing(candidates: DataFrame, path: str, key: str | Sequence[str],
                   keys: Sequence[str] = ()) -> None:
    """Append the rows of candidates whose key is not in the table yet; creates the table if absent."""
    spark = candidates.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as error:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        existing = None
    fresh = candidates if existing is None else only_missing(candidates, existing, key)
    write_table(fresh, path, keys, mode="append")


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack parts by column name; columns a part lacks become null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All daily parts below a folder in one scan; later parts may have further columns."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)


def cluster_code(n_cluster: Column, method: Column, reduction: Column, dims: Column) -> Column:
    """Text key of a cluster set-up."""
    reduced = F.when(reduction.isNull(), F.lit("(noReduce)")).otherwise(F.format_string("(%s,%d)", reduction, dims))
    grouped = F.concat(F.format_string("%s(nc=%d)", method, n_cluster), reduced)
    return F.when(n_cluster > 1, grouped).otherwise(F.lit("noCluster"))


def run_code(model: Column, cluster: Column, season: Column,
             feature_reduction: Column | None = None, feature_dims: Column | None = None) -> Column:
    """Text key of a run, made from its settings."""
    features = F.lit("noFeatureReduce")
    if feature_reduction is not None:
        named = F.format_string("%s(%d)", feature_reduction, feature_dims)
        features = F.when(feature_reduction.isNull(), features).otherwise(named)
    return F.concat_ws("_", model, cluster, features, season)


def write_run(root: str, run: dict, clusters: DataFrame, metrics: DataFrame, timings: DataFrame,
              forecasts: DataFrame) -> None:
    """Append the four result tables of one run; run settings become columns.

    ``run`` holds at least ``run_id``, ``model`` and ``season``; tables are partitioned by model and season. Every row
    has the number of its attempt, and metrics come last: an attempt that broke off has none, and ``read_run`` leaves its
    rows out.
    """
    stamp = {**run, "attempt": uuid.uuid4().hex}
    tables = {"clusters": clusters, "timings": timings, "forecasts": forecasts, "metrics": metrics}
    for name in RUN_TABLES:
        stamped = tables[name].withColumns({k: F.lit(v) for k, v in stamp.items()})
        write_table(stamped, f"{root}/{name}", ("model", "season"), mode="append")


def read_run(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a result table that belong to complete attempts; of several complete ones of a run the first by number."""
    done = spark.read.parquet(f"{root}/metrics").groupBy("run_id").agg(F.min("attempt").alias("attempt"))
    return spark.read.parquet(f"{root}/{name}").join(done, ["run_id", "attempt"], "left_semi")
