"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Row i of the matrix says how many rows of input partition i go to each shard. Given the partition sizes and the shard
sizes, the rows of a uniform random permutation follow a multivariate hypergeometric law. No task needs the whole
matrix: the partitions form a binary tree, at each node the shard counts of the left half are drawn given those of the
whole, and the generator of a node is seeded by its place. So a task walks from the root to its own partition and
always meets the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut_lineage

#: Rows that one task of the last permutation sorts, about.
CELL_ROWS = 1 << 14
#: From this population on numpy's own generator refuses.
LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` of good + bad; populations of any size."""
    if good < LARGE and bad < LARGE:
        return int(rng.hypergeometric(good, bad, drawn)) if good + bad and drawn else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    total = good + bad
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    spread = (drawn / total * good * (bad / total) * ((total - drawn) / max(1, total - 1))) ** 0.5
    reach = int(12 * spread) + 64  # beyond 12 standard deviations the law holds less than a double resolves
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(drawn - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - drawn + k[:-1] + 1)
    log_law = np.concatenate([[0.0], np.cumsum(step)])
    law = np.cumsum(np.exp(log_law - log_law.max()))
    return int(k[min(np.searchsorted(law, rng.random() * law[-1], "right"), len(k) - 1)])


def split(rng: np.random.Generator, counts: list[int], drawn: int) -> list[int]:
    """Counts by colour among ``drawn`` of the whole."""
    out, rest = [], sum(counts)
    for have in counts:
        took = hypergeometric(rng, have, rest - have, drawn)
        out.append(took)
        rest, drawn = rest - have, drawn - took
    return out


def matrix_row(sizes: np.ndarray, shards: list[int], at: int, seed: int) -> list[int]:
    """Row ``at`` of the matrix with row sums ``sizes`` and column sums ``shards``."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    low, high, counts = 0, len(sizes), list(shards)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), counts, int(before[middle] - before[low]))
        if at < middle:
            high, counts = middle, left
        else:
            low, counts = middle, [a - b for a, b in zip(counts, left, strict=True)]
    return counts


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """The rows of ``df`` with ``shard`` int and ``slot`` long, a uniform random permutation cut into shards.

    Shard sizes differ by one at most, the first shards are the larger ones; slots run without a gap from 0. Every row,
    repeated or null or not, takes a slot of its own, so no group of equal rows can weigh on a shard. The rows are
    written to the checkpoint folder first: what a partition holds, and in which order, is then fixed for every later
    try of a task, and so is the result. An empty table gives no rows. Columns of ``df`` named shard or
    slot, in any case, are replaced; all others may have any name.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    held = cut_lineage(df.select(F.struct(*kept).alias("_row")))
    count = held.groupBy(F.spark_partition_id().alias("part")).count()
    found = {r["part"]: r["count"] for r in count.collect()}  # one number for each partition
    sizes = np.array([found.get(k, 0) for k in range(max(found, default=-1) + 1)], np.int64)
    total = int(sizes.sum())
    goal = [total // shards + (k < total % shards) for k in range(shards)]
    cells = max(1, -(-total // shards // CELL_ROWS))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, labels, done = TaskContext.get().partitionId(), None, 0
        rng = np.random.default_rng([seed, at])
        for batch in batches:
            if labels is None:  # the local permutation: shard labels in random order
                labels = np.repeat(np.arange(shards, dtype=np.int32), matrix_row(sizes, goal, at, seed + 1))
                rng.shuffle(labels)
            mine = labels[done:done + batch.num_rows]
            done += batch.num_rows
            order = rng.integers(0, 1 << 62, batch.num_rows)
            cell = (order >> 31) * cells >> 31  # shares of equal width of the order, cells < 2^31
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine), pa.array(cell), pa.array(order)], ["_row", "shard", "_cell", "_order"])

    dealt = held.mapInArrow(deal, f"{fields}, shard int, _cell bigint, _order bigint")
    sums = dealt.groupBy("shard", "_cell").count()
    before = sums.selectExpr("shard", "_cell", "sum(count) over (partition by shard order by _cell) - count as _before")
    ranked = dealt.selectExpr("*", "row_number() over (partition by shard, _cell order by _order) - 1 as _rank")
    placed = ranked.join(before, ["shard", "_cell"])
    return placed.select(*[F.col("_row")[c].alias(c) for c in kept], "shard", (F.col("_before") + F.col("_rank")).cast("long").alias("slot"))
