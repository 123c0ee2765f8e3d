"""Ordered scans over groups of any size.

A plain window puts a whole group into one task. Here the caller gives a block number that rises with
the order, so a group is split into blocks: each block is scanned by itself, the blocks are summarised
in one row each, the summaries are scanned, and every row gets the carry of the blocks before its own.
Only the summaries, one row per block, meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16


def number_block(order: str, size: int = BLOCK) -> Column:
    """Block of an integer order column."""
    return F.floor(F.col(order) / size)


def even_block(df: DataFrame, order: str, rows: int = BLOCK) -> Column:
    """Block that cuts the range of an integer order column into equal parts of about ``rows`` rows each.

    Summaries have one row per group and block, so their number follows that of the groups, not of the rows.
    """
    lo, hi, n = (df.agg(f.alias("x")).scalar() for f in (F.min(order), F.max(order), F.count("*")))
    return F.floor((F.col(order) - lo) / F.ceil((hi - lo + 1) / F.greatest(F.lit(1), F.ceil(n / rows))))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "pos") -> DataFrame:
    """0-based position of each row within its group; the order must have no ties."""
    keys = list(keys)
    blocks = df.withColumn("_blk", block)
    inside = W.partitionBy(*keys, "_blk").orderBy(*order)
    local = blocks.withColumn("_rn", F.row_number().over(inside) - 1)
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    counts = blocks.groupBy(*keys, "_blk").agg(F.count("*").alias("_n"))
    carry = counts.select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = local.join(carry, [*keys, "_blk"])
    return joined.withColumn(out, F.col("_rn") + F.col("_off")).drop("_blk", "_rn", "_off")


def drop_groups(df: DataFrame, keys: Sequence[str], order: str, clock: str, block: Column) -> tuple[DataFrame, DataFrame]:
    """Number the runs between drops of the clock, per group.

    Returns the rows with ``_blk`` and the run number inside the block ``_run``, and one row per block
    with ``_off``, the runs begun before it. The run of a row is ``_run + _off``.
    """
    keys = list(keys)
    inside = W.partitionBy(*keys, "_blk").orderBy(order)
    blocks = df.withColumn("_blk", block)
    marked = blocks.withColumn("_prev", F.lag(clock).over(inside)).withColumn(
        "_drop", F.coalesce((F.col(clock) < F.col("_prev")).cast("int"), F.lit(0)))
    local = marked.withColumn("_run", F.sum("_drop").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, "_blk").agg(
        F.min_by(clock, order).alias("_first"), F.max_by(clock, order).alias("_last"),
        F.max("_run").alias("_runs"))
    along = W.partitionBy(*keys).orderBy("_blk")
    start = F.coalesce((F.col("_first") < F.lag("_last").over(along)).cast("int"), F.lit(0))
    begun = ends.withColumn("_start", start)
    earlier = F.coalesce(F.sum("_runs").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    started = F.sum("_start").over(along.rowsBetween(W.unboundedPreceding, 0))
    carry = begun.select(*keys, "_blk", (earlier + started).alias("_off"))
    return local.drop("_prev", "_drop"), carry
