"""Meter readings and customer allocations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

READING_SCHEMA = "id string, code string, value double"


def read_readings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Space separated files without header: meter id, time code, value."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(READING_SCHEMA).option("sep", " ").csv(paths)


def read_allocations(spark: SparkSession, path: str) -> DataFrame:
    """Meter id and customer class, both as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).select("id", "code")


def register(df: DataFrame, name: str) -> DataFrame:
    """Expose a table to SQL under a name."""
    df.createOrReplaceTempView(name)
    return df


def materialise(df: DataFrame) -> DataFrame:
    """Keep a table that several queries reuse; what does not fit in memory goes to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
