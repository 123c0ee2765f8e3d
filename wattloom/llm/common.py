"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.session import checkpoint_folder

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_side(df: DataFrame, most: int = 1 << 16) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows when counted, else as it is for a shuffled join.

    ``df`` should be checkpointed and narrow; the size is checked on the very rows that would be sent.
    """
    return F.broadcast(df) if df.count() <= most else df


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table below the shared checkpoint folder and read again; smaller than a checkpoint."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing needs any more."""
    session = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
