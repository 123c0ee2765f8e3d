"""SimHash near duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For a radius r every bit position gets a non-zero vector of r + 1 bits; for each of the
2^(r+1) - 1 non-zero vectors v, one table keeps the positions whose vector has an odd product with v. The vectors of at
most r differing positions span less than all r + 1 dimensions, so some v is orthogonal to all of them: its table keeps
none of the differing positions, and the pair has equal keys there. No pair within the radius can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.blobs import give_back
from wattloom.operators.components import components
from wattloom.session import cut_lineage

BITS = 64
#: Buckets with more fingerprints than this are split by a second set of masks over the bits that the first one leaves
#: out. What then still shares a bucket differs in about 14 bits only, so a bucket has some 16,000 fingerprints at most.
SPLIT_ABOVE = 2048


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """SimHash of the word shingles of a text with A-Z in lower case; 0 without words."""
    words = text.lower().split()
    count = len(words)
    if not count:
        return 0
    joined = b" ".join(words)
    if count <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, count)
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: count - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin:begin + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``key`` and fingerprint (signed long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t or b"", shingle, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp bigint").select(F.col("key").alias(key), "fp")


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """Masks over ``positions``, one of which leaves out any ``radius`` of them."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << p for at, p in enumerate(positions) if ((at % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _links(radius: int):
    """Links between fingerprints of one bucket; rows come sorted by bucket, and no bucket is large."""

    def linked(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        label, left, right = np.arange(len(fp)), [], []
        at, step = np.arange(len(fp)), 1
        while len(at):
            at = at[at + step < len(fp)]
            at = at[bucket[at] == bucket[at + step]]
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
            near = near[label[near] != label[near + step]]  # what is joined already needs no further link
            if len(near):
                left.append(fp[near])
                right.append(fp[near + step])
                a, b = label[near], label[near + step]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(label, short := label[label]):
                    label = short
            step += 1
        ends = [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)])
            starts = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
            if len(starts):  # the last bucket may go on in the next batch
                yield close(held[:starts[-1]])
                held = held[starts[-1]:]
        yield close(held)
        give_back()

    def close(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        return linked(np.cumsum(new), rows[:, 2].copy().view(np.uint64))

    return run


def near_links(fps: DataFrame, radius: int = 3, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links u, v that join all fingerprints within ``radius`` bits of each other; ``fps`` has distinct values in ``fp``.

    The links connect exactly what the full set of close pairs connects; a pair that is joined by other links of its
    bucket is left out, so a dense bucket gives about as many links as it has members.
    """
    first = covering_masks(radius, list(range(BITS)))
    tables = fps.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket"), F.col("fp").alias("fp")) for t, m in enumerate(first)])).alias("x")).select("x.*")
    crowded = cut_lineage(tables.groupBy("tab", "bucket").count().where(F.col("count") > split_above).select("tab", "bucket"))
    if not crowded.isEmpty():
        pieces = []
        for t, m in enumerate(first):
            rest = covering_masks(radius, [p for p in range(BITS) if not m >> p & 1])
            pieces += [F.when(F.col("tab") == t, F.array(*[F.struct(F.lit(len(first) * (1 + t) + k).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m | r))).alias("bucket"), F.col("fp").alias("fp")) for k, r in enumerate(rest)]))]
        split = tables.join(crowded, ["tab", "bucket"], "left_semi").select(F.explode(F.coalesce(*pieces)).alias("x")).select("x.*")
        tables = tables.join(crowded, ["tab", "bucket"], "left_anti").unionByName(split)
    dealt = tables.select(F.col("tab").cast("long").alias("tab"), "bucket", "fp").repartition("tab", "bucket").sortWithinPartitions("tab", "bucket", "fp")
    return dealt.mapInArrow(_links(radius), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: key, fp (signed long) and component_id, the smallest key reachable by links.

    Fingerprints link at ``radius`` or fewer differing bits. Copies of a text share a fingerprint and are grouped before
    any search, so however many there are, the tables hold their fingerprint once. Texts that are null or have no words
    have fingerprint 0, which links like any other. Null keys are never a component's smallest key, unless it has no
    other; then component_id is null. Repeated rows stay. Other columns are not read. An empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, key, text, shingle, seed))
    groups = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("_first")))
    links = cut_lineage(near_links(groups.select("fp"), radius).distinct())
    ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    roots = components(ends, links).select(F.col("node").alias("fp"), "root")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")
