"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import word_count
from wattloom.session import cut_lineage

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Pieces that are packed together, about. Blocks leave a few part-filled sequences each, whatever the input.
BLOCK = 1 << 14


def cost(length: int) -> float:
    """Work of training on one sequence: a term for each token and one for each pair of tokens."""
    return length * (1 + length / 8192)


def best_fit(lengths: Sequence[int], opened: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the fill of each bin. Items come longest first.

    An item goes into the open bin that it leaves the least room in; if it fits in none, a bin of the smallest size in
    ``opened`` that holds it is opened.
    """
    room: list[list[int]] = [[] for _ in range(max(opened) + 1)]
    free, bins, offsets, fill, sizes = 0, [], [], [], []
    for need in lengths:
        fits = free >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            at, left = len(fill), next(c for c in opened if c >= need)
            fill.append(0)
            sizes.append(left)
        bins.append(at)
        offsets.append(fill[at])
        fill[at] += need
        left -= need
        if left:
            room[left].append(at)
            free |= 1 << left
    return bins, offsets, fill


def pack(lengths: Sequence[int], permitted: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Bin, offset and final bin size of each item, items longest first.

    The permitted sizes are weighed jointly: for each smallest size to open, the items are packed and every bin is cut
    down to the smallest size that holds its contents; the least total cost wins.
    """
    best = None
    for floor in range(len(permitted)):
        bins, offsets, fill = best_fit(lengths, permitted[floor:])
        final = [next(c for c in permitted if c >= f) for f in fill]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, offsets, final
    _, bins, offsets, final = best
    return bins, offsets, [final[b] for b in bins]


def pack_documents(docs: DataFrame, key: str = "doc_id", length: str = "length", permitted: Sequence[int] = LENGTHS, block: int = BLOCK) -> DataFrame:
    """One row per piece: key, piece int, start long, length int, bin_id long, bin_offset int, bin_length int.

    A document longer than the largest permitted length is cut into pieces of that length and a rest; ``start`` is the
    piece's first token. Pieces are dealt at random into blocks of bounded size, each packed by itself. A document of
    length 0 or null is one piece of length 0 in no bin (bin columns null). Rows with equal keys are separate documents,
    null keys stay, other columns are not read, an empty table gives no rows. The pieces are written to the checkpoint
    folder with a number each, so a repeated task packs the same block.
    """
    permitted = sorted(permitted)
    most, kind = permitted[-1], docs.schema[key].dataType.simpleString()
    items = docs.select(F.col(key).alias("key"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"))
    last = F.greatest(F.lit(0), F.ceil(F.col("length") / most) - 1).cast("int")
    pieces = items.select("key", "length", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * most
    pieces = pieces.select("key", "piece", start.alias("start"), F.least(F.lit(most), F.col("length") - start).cast("int").alias("length"))
    pieces = cut_lineage(pieces.withColumn("number", F.monotonically_increasing_id()))
    blocks = max(1, -(-pieces.where("length > 0").count() // block))
    fields = f"key {kind}, piece int, start bigint, length int, bin_id bigint, bin_offset int, bin_length int"
    dealt = pieces.where("length > 0").withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([("length", "descending"), ("number", "ascending")]).combine_chunks()
        bins, offsets, sizes = pack(rows["length"].to_pylist(), permitted)
        number = rows["block"].to_numpy() * (1 << 24) + np.array(bins, np.int64)
        out = [rows[c].combine_chunks() for c in ("key", "piece", "start", "length")] + [pa.array(number), pa.array(offsets, pa.int32()), pa.array(sizes, pa.int32())]
        yield from pa.Table.from_arrays(out, ["key", "piece", "start", "length", "bin_id", "bin_offset", "bin_length"]).to_batches()

    packed = dealt.groupBy("block").applyInArrow(run, fields)
    none = pieces.where("length <= 0").selectExpr("key", "piece", "start", "length", "cast(null AS bigint) AS bin_id", "cast(null AS int) AS bin_offset", "cast(null AS int) AS bin_length")
    return packed.unionByName(none).withColumnRenamed("key", key)


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", permitted: Sequence[int] = LENGTHS) -> DataFrame:
    """``pack_documents`` with the number of words as length."""
    return pack_documents(docs.select(F.col(key), word_count(F.col(text)).alias("_length")), key, "_length", permitted)
