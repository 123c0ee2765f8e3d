"""Vector code compression: product codes whose codebooks come from Ball k-means, in whole numbers.

Vectors become whole numbers and are cut into parts; each part position has its own codebook. A round assigns every part
to its nearest entry and moves each entry to the mean of its parts. The assignment is exact, but hardly ever compares a
part with all entries. The members of an entry form a ball around it. Only entries closer than twice its radius are its
neighbours; a ball is stable, and none of its parts is looked at, if neither it nor a neighbour moved since the last
round. Parts nearer to the entry than half of the way to its nearest neighbour form the core and stay. The rest of the ball
is cut into rings by the half ways to its neighbours, in order: a part in the n-th ring is compared with the first n
neighbours only. All bounds are compared as squared whole numbers, with ties on the outer side, so equal distances are
always compared and go to the lower index.

Vectors travel packed, some thousands to a row, with their codes. A round reads the rows, writes them with new codes and
sends sums by part and entry; the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.blobs import give_back
from wattloom.llm.common import dropped, small_side, written
from wattloom.operators.joins import hot_join

#: Vectors packed to one row, at most.
BLOCK = 8192


@dataclass(frozen=True)
class Codebook:
    """Entries (a row each) of one part position, and which of them moved in the last round."""

    entries: np.ndarray
    moved: np.ndarray

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the others by squared distance, and these distances."""
        apart = ((self.entries[:, None] - self.entries[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, -1)
        order = np.argsort(apart, axis=1, kind="stable")
        return order[:, 1:], np.take_along_axis(apart, order, axis=1)[:, 1:]


def assign(parts: np.ndarray, codes: np.ndarray, radii: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each part, the new squared radius of each ball and the number of distances computed.

    ``codes`` are the entries of the round before and ``radii`` the squared radii of their balls then; any codes are right
    if every entry counts as moved.
    """
    near, apart = book.neighbours()
    beside = apart <= 4 * radii[:, None]
    stable = ~book.moved & ~(beside & book.moved[near]).any(axis=1)
    at = np.flatnonzero(~stable[codes])
    own, here = codes[at], parts[at]
    distance = ((here - book.entries[own]) ** 2).sum(axis=1)
    rings = (apart[own] <= 4 * distance[:, None]).sum(axis=1)  # apart is sorted: the number of neighbours to compare with
    out = codes.copy()
    outside = np.flatnonzero(rings)
    if len(outside):
        count = rings[outside]
        row = np.repeat(np.arange(len(outside)), count)
        starts = np.cumsum(count) - count
        other = near[own[outside][row], np.arange(len(row)) - starts[row]]
        # the lower index wins among equal distances
        scored = ((here[outside][row] - book.entries[other]) ** 2).sum(axis=1) * len(book.entries) + other
        best = np.minimum(np.minimum.reduceat(scored, starts), distance[outside] * len(book.entries) + own[outside])
        out[at[outside]] = best % len(book.entries)
        distance[outside] = best // len(book.entries)
    found = np.zeros(len(radii), np.int64)
    np.maximum.at(found, out[at], distance)
    # a stable ball keeps its members, and with them its radius; others may only have joined it
    found[stable] = np.maximum(found[stable], radii[stable])
    return out, found, len(at) + int(rings.sum())


def largest(width: int, parts: int, entries: int) -> int:
    """Whole numbers beyond this are cut to it: errors, and squared distances times the number of entries, stay exact in 64 bits."""
    return 1 << min(30, (62 - max(width, -(-width // parts) * entries).bit_length()) // 2 - 1)


def _cuts(width: int, parts: int) -> list[int]:
    return [p * width // parts for p in range(parts + 1)]


_BLOCKS = pa.schema([("keys", pa.binary()), ("labels", pa.binary()), ("known", pa.binary()), ("n", pa.int32()), ("depth", pa.int32()), ("vectors", pa.binary()), ("codes", pa.binary()), ("radii", pa.binary())])
_BLOCKS_SQL = "keys binary, labels binary, known binary, n int, depth int, vectors binary, codes binary, radii binary"


def _packed(width: int, parts: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                n = batch.num_rows
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                flat = flat.astype(np.int16) if -(1 << 15) <= flat.min(initial=0) and flat.max(initial=0) < 1 << 15 else flat
                keys, labels = [c.fill_null(0).to_numpy().astype("<i8") for c in (batch.column(0), batch.column(1))]
                known = (batch.column(0).is_valid().to_numpy(zero_copy_only=False) + 2 * batch.column(1).is_valid().to_numpy(zero_copy_only=False)).astype(np.uint8)
                values = [keys.tobytes(), labels.tobytes(), known.tobytes(), n, flat.dtype.itemsize, flat.tobytes(), bytes(n * parts), np.full((parts, entries), 1 << 58, "<i8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCKS, strict=True)], schema=_BLOCKS)
        give_back()

    return run


def _vectors(row: dict, width: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], np.int16 if row["depth"] == 2 else np.int32).astype(np.int64).reshape(-1, width)


def _assigned(width: int, books: list[Codebook]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    cuts = _cuts(width, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors = _vectors(row, width)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(books), -1)
                radii = np.frombuffer(row["radii"], "<i8").reshape(len(books), -1)
                found = [assign(vectors[:, a:b], c.astype(np.int64), r, book) for a, b, c, r, book in zip(cuts[:-1], cuts[1:], codes, radii, books, strict=True)]
                row["codes"] = b"".join(c.astype(np.uint8).tobytes() for c, _, _ in found)
                row["radii"] = b"".join(r.astype("<i8").tobytes() for _, r, _ in found)
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS)
        give_back()

    return run


def _sums(width: int, parts: int, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """part, entry, place within the part, number of parts and their sum; added up within the task."""
    cuts = _cuts(width, parts)
    names = ["part", "entry", "place", "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in batch.select(["depth", "vectors", "codes"]).to_pylist():
                vectors = _vectors(row, width)
                for p, codes in enumerate(np.frombuffer(row["codes"], np.uint8).reshape(parts, -1)):
                    count[p] += np.bincount(codes, minlength=entries)
                    order = np.argsort(codes, kind="stable")
                    used, starts = np.unique(codes[order], return_index=True)
                    total[used, cuts[p]:cuts[p + 1]] += np.add.reduceat(vectors[order, cuts[p]:cuts[p + 1]], starts, axis=0)
        part = np.searchsorted(cuts, np.arange(width), "right") - 1
        entry, place = np.nonzero(count[part].T)
        columns = [part[place], entry, place - np.array(cuts)[part[place]], count[part[place], entry], total[entry, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)
        give_back()

    return run


def _coded(width: int, entries: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    cuts = _cuts(width, len(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vectors, codes = _vectors(row, width), np.frombuffer(row["codes"], np.uint8).reshape(len(entries), -1)
                error = sum(((vectors[:, a:b] - e[c]) ** 2).sum(axis=1) for a, b, e, c in zip(cuts[:-1], cuts[1:], entries, codes, strict=True))
                known = np.frombuffer(row["known"], np.uint8)
                keys, labels = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["labels"], "<i8")
                code = pa.array([bytes(c) for c in np.ascontiguousarray(codes.T)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=known & 1 == 0), pa.array(labels, mask=known & 2 == 0), code, pa.array(error)], ["key", "label", "code", "error"])
        give_back()

    return run


@dataclass(frozen=True)
class Codes:
    """``rows``: key, label, code (a byte for each part) and error of every vector. ``books``: for each part position its
    entries, a row each."""

    rows: DataFrame
    books: list[np.ndarray]

    def books_sha256(self) -> str:
        """Digest of all components by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codes of all sound vectors, and the codebooks.

    A component x counts as floor(scale * x). The codebooks start as the parts of the vectors with the smallest keys (equal
    keys by their vectors, null keys last); fewer vectors give fewer entries. Entries without parts stay. Means are rounded
    down. Left out are null and empty vectors, those with null or non-finite components, and those of another length than
    most have (of equally frequent lengths the least counts). If the length is no multiple of ``parts``, some parts are a component longer. Numbers beyond
    ``largest`` (2^26 for 64 components in 8 parts and 16 entries) are cut to it. Repeated rows count each time. Other columns are not read; an empty table gives no rows and no
    entries.
    """
    if not (1 <= entries <= 256 and parts >= 1 and rounds >= 0):
        raise ValueError("need 1 to 256 entries, a part and no negative rounds")
    named = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    sound = named.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    widths = sound.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths["width"] if widths else 1
    most = F.lit(float(largest(width, parts, entries)))
    whole = sound.where(F.size("v") == width).withColumn("v", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, most), -most)).cast("int")))
    first = [r["v"] for r in whole.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).select("v").collect()]  # the first codebooks
    many, cuts = max(len(first), 1), _cuts(width, parts)
    start = np.array(first, np.int64).reshape(len(first), width) if first else np.zeros((1, width), np.int64)
    books = [Codebook(start[:, a:b].copy(), np.ones(many, bool)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    blocks = written(whole.select("key", "label", "v").mapInArrow(_packed(width, parts, many), _BLOCKS_SQL))
    for step in range(rounds + 1):
        assigned = written(blocks.mapInArrow(_assigned(width, books), _BLOCKS_SQL))
        dropped(blocks)
        blocks = assigned
        if step < rounds:
            books = _moved(books, blocks.mapInArrow(_sums(width, parts, many), "part bigint, entry bigint, place bigint, n bigint, total bigint"))
    rows = blocks.mapInArrow(_coded(width, [b.entries for b in books]), "key bigint, label bigint, code binary, error bigint")
    return Codes(rows, [b.entries for b in books] if first else [b.entries[:0] for b in books])


def _moved(books: list[Codebook], sums: DataFrame) -> list[Codebook]:
    """Codebooks of means; one number for each component of each entry comes to the driver."""
    out = [book.entries.copy() for book in books]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return [Codebook(new, (new != old.entries).any(axis=1)) for new, old in zip(out, books, strict=True)]


def with_label_error(codes: Codes) -> DataFrame:
    """Rows with label_error, the error summed over all rows of the same label, null labels together; null beyond 64 bits."""
    rows = codes.rows.withColumn("_label", F.struct("label"))  # a struct with a null field equals its like
    sums = written(rows.groupBy("_label").agg(F.expr("try_cast(sum(cast(error AS decimal(38, 0))) AS bigint)").alias("label_error")))
    sought = small_side(sums)
    joined = rows.join(sought, "_label") if sought is not sums else hot_join(rows, sums, "_label", ["key", "code"])
    return joined.drop("_label")
