"""Benchmark decontamination by a prefix-filtered join of shingle sets.

An item is cut into windows of a fixed number of consecutive words; an item of fewer words is one window. A window is the
set of its word shingles, each with its place in the window. A document holds the window at some word if at least
``containment`` of these shingles stand there, each at its place. With m shingles, of which t must be found, any t of them
include one of the m - t + 1 rarest: only these, the prefix, are looked up in the documents. What is found gives the place
where the window would begin; places that leave the document are dropped (length and position bounds), and the words of
the document at that place, as many as the window has, are compared one by one.

Documents are read twice, once to count how often each shingle of the items occurs in them and once for the prefixes, and
their texts are never shuffled: a found prefix shingle carries the few words around it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.blobs import give_back
from wattloom.llm.common import small_side, written
from wattloom.operators.joins import hot_join

#: Bytes of text that are worked on at once; a longer text is one piece of work.
SLAB = 1 << 20
#: Bits of a filter: 32 for each shingle, between these bounds (8 MB at most). A fuller filter lets more pass to the join.
FILTER_BITS = (16, 26)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWER[_b] = _b
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Words:
    """Words of several texts, one after the other: lower-cased bytes, begin and end of each word, text it belongs to, hash."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    hash: np.ndarray

    def joined(self, first: int, last: int) -> bytes:
        """Words ``first`` to ``last - 1``, with one space between them."""
        return b" ".join(self.text[a:b].tobytes() for a, b in zip(self.begin[first:last].tolist(), self.end[first:last].tolist(), strict=True))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``size`` words of one text."""
        count = len(self.hash) - size + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        found = np.full(count, size, np.uint64)
        for place in range(size):
            found += self.hash[place:place + count] * np.uint64(pow(_BASE, place + 1, 1 << 64))
        inside = np.flatnonzero(self.owner[:count] == self.owner[size - 1:])
        return inside, _mixed(found[inside])


def words_of(texts: Sequence[bytes]) -> Words:
    """Words of UTF-8 texts: runs of digits, letters and characters beyond ASCII, A-Z in lower case."""
    text = _LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
    edges = np.diff((text != 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    rows = np.cumsum([0, *[len(t) + 1 for t in texts]])
    owner = np.searchsorted(rows, begin, "right") - 1
    hashes, first = np.empty(len(begin), np.uint64), 0
    while first < len(begin):  # sums of bytes times powers; a power less for every byte before the word
        last = max(first + 1, int(np.searchsorted(end, begin[first] + SLAB, "right")))
        low, size = int(begin[first]), 1 << max(20, int(end[last - 1] - begin[first]).bit_length())
        part = _BYTE[text[low:int(end[last - 1])]] * _powers(_BASE, size)[:int(end[last - 1]) - low]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        a, b = begin[first:last] - low, end[first:last] - low
        hashes[first:last] = (sums[b] - sums[a]) * _powers(_INVERSE, size)[a]
        first = last
    return Words(text, begin, end, owner, _mixed(hashes))


def _slabs(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """Number of the first row and words of some rows at a time; a null text has none."""
    first, held, size = 0, [], 0
    for text in column.cast(pa.binary()).to_pylist():
        held.append(text or b"")
        size += len(held[-1])
        if size >= SLAB:
            yield first, words_of(held)
            first, held, size = first + len(held), [], 0
    if held:
        yield first, words_of(held)


@dataclass(frozen=True)
class Filter:
    """Bloom filter of hashes with two probes."""

    bits: int
    map: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes & np.uint64((1 << self.bits) - 1)
        found = self._at(hashes >> np.uint64(64 - self.bits))
        found[found] = self._at(low[found])
        return found

    def _at(self, place: np.ndarray) -> np.ndarray:
        return (self.map[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(hashes: DataFrame) -> Filter:
    """Filter of the column ``hash`` (distinct values). What comes to the driver is the filter, 8 MB at most."""
    bits = min(max((32 * hashes.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    places = F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)))
    place = hashes.select(F.explode(places).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    cells = place.groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    map_ = np.zeros(1 << (bits - 6), np.uint64)
    map_[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return Filter(bits, map_)


def item_windows(items: DataFrame, key: str, text: str, window: int, shingle: int) -> DataFrame:
    """item, window (its words), size (their number) and hashes (of its shingles by place) of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in _slabs(batch.column(1)):
                counts = np.bincount(words.owner)
                starts = np.cumsum(counts) - counts
                rows, found, sizes, hashes = [], [], [], []
                known = {}
                for size in {min(shingle, int(n)) for n in counts if n}:
                    at, values = words.shingles(size)
                    known[size] = dict(zip(at.tolist(), values.view(np.int64).tolist(), strict=True))
                for row in np.flatnonzero(counts).tolist():
                    size = min(window, int(counts[row]))
                    wide = min(shingle, size)
                    for begin in range(starts[row], starts[row] + counts[row] - size + 1):
                        rows.append(first + row)
                        found.append(words.joined(begin, begin + size))
                        sizes.append(size)
                        hashes.append([known[wide][at] for at in range(begin, begin + size - wide + 1)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary()).cast(pa.string()),
                                                  pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["item", "window", "size", "hashes"])
        give_back()

    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item {kind}, window string, size int, hashes array<bigint>")


def shingle_counts(docs: DataFrame, text: str, sizes: Sequence[int], wanted: Filter) -> DataFrame:
    """hash and n: how often each shingle that passes the filter stands in all documents, added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in _slabs(batch.column(0)):
                for size in sizes:
                    _, hashes = words.shingles(size)
                    values, counts = np.unique(hashes[wanted.has(hashes)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["hash", "n"])
        give_back()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def prefix_hits(docs: DataFrame, key: str, text: str, window: int, sizes: Sequence[int], wanted: Filter) -> DataFrame:
    """For every document a row with key and n_words, and for every shingle that passes the filter one with its first word
    ``at``, its hash, the words around it (``context``) and the number of these before it (``lead``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            for first, words in _slabs(batch.column(2)):
                counts = np.bincount(words.owner)
                starts = np.cumsum(counts) - counts
                totals[first:first + len(counts)] = counts
                rows, at, hashes, lead, context = [], [], [], [], []
                for size in sizes:
                    places, found = words.shingles(size)
                    passed = wanted.has(found)
                    for place, value in zip(places[passed].tolist(), found[passed].view(np.int64).tolist(), strict=True):
                        row = int(words.owner[place])
                        low = max(int(starts[row]), place - (window - size))
                        rows.append(first + row)
                        at.append(place - int(starts[row]))
                        hashes.append(value)
                        lead.append(place - low)
                        context.append(words.joined(low, min(int(starts[row] + counts[row]), place + window)))
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(rows), batch.column(1).type), pa.nulls(len(rows), pa.int64()), pa.array(at, pa.int64()),
                                                  pa.array(hashes, pa.int64()), pa.array(lead, pa.int32()), pa.array(context, pa.binary()).cast(pa.string())], names)
            nothing = [pa.nulls(batch.num_rows, kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals), *nothing], names)
        give_back()

    names = ["row", "key", "n_words", "at", "hash", "lead", "context"]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row bigint, key {kind}, n_words bigint, at bigint, hash bigint, lead int, context string")


def _aligned(shingle: int) -> Column:
    """Number of shingles of the window that stand at their place in the words of the document found there."""
    same = F.zip_with("piece", "words", lambda a, b: a == b)
    wide = F.least(F.lit(shingle), F.col("size"))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n"))
    step = lambda s, equal: F.struct(F.when(equal, s["run"] + 1).otherwise(0).alias("run"), (s["n"] + F.when(equal & (s["run"] + 1 >= wide), 1).otherwise(0)).alias("n"))
    return F.aggregate(same, start, step, lambda s: s["n"])


@dataclass(frozen=True)
class Leaks:
    """``docs``: row, key, n_words. ``spans``: row, start, size, window for each place where a window was found.
    ``held``: window, item."""

    docs: DataFrame
    spans: DataFrame
    held: DataFrame


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
               window: int = 10, shingle: int = 5, containment: float = 1.0) -> Leaks:
    """All places of ``docs`` that hold a window of ``items``.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. With ``containment`` 1 a window
    is found where its words stand one after the other; below 1 some words may differ. Rows are judged one by one, also
    those with equal or null keys; a null text has no words; items without words hold no window. The windows of an item
    with a null key are found, but it is not named as an item. Repeated items count once. Only the named columns are read. Empty tables give empty results.
    """
    if not (1 <= shingle <= window and 0 < containment <= 1):
        raise ValueError("need 1 <= shingle <= window and 0 < containment <= 1")
    cut = written(item_windows(items, item_key, item_text, window, shingle))
    distinct = cut.groupBy("window").agg(F.first("size").alias("size"), F.first("hashes").alias("hashes"))
    windows = written(distinct.select(F.monotonically_increasing_id().alias("id"), "*"))
    held = cut.where("item IS NOT NULL").select("item", "window").distinct().join(windows.select("window", F.col("id")), "window").select(F.col("id").alias("window"), "item")
    sizes = [r["size"] for r in windows.select(F.least(F.lit(shingle), "size").alias("size")).distinct().orderBy("size").collect()]  # ``shingle`` at most
    need = F.ceil(F.lit(containment) * F.size("hashes")).cast("int")
    tokens = windows.select("id", (F.size("hashes") - need + 1).alias("prefix"), need.alias("need"), F.posexplode("hashes").alias("place", "hash"))
    counts = shingle_counts(docs, text, sizes, filter_of(tokens.select("hash").distinct()))
    rare = tokens.join(counts, "hash", "left").selectExpr(
        "*", "row_number() OVER (PARTITION BY id ORDER BY coalesce(n, 0), hash, place) AS rank", "count(n) OVER (PARTITION BY id) AS present")
    chosen = rare.where("rank <= prefix AND n > 0 AND present >= need").select("hash", "place", "need", "id")
    prefix = written(chosen.join(windows.select("id", "window", "size"), "id").withColumnRenamed("id", "window_id"))
    hits = written(prefix_hits(docs, key, text, window, sizes, filter_of(prefix.select("hash").distinct())))
    sought = small_side(prefix)
    looked = hits.where(F.col("hash").isNotNull()).select("row", "at", "hash", "lead", "context")
    paired = looked.join(sought, "hash") if sought is not prefix else hot_join(looked, prefix, "hash", ["row", "at"])
    bounded = paired.where("lead >= place").withColumn("words", F.split("window", " ")).withColumn("piece", F.slice(F.split("context", " "), F.col("lead") - F.col("place") + 1, F.col("size")))
    found = bounded.where((F.size("piece") == F.col("size")) & (_aligned(shingle) >= F.col("need")))
    spans = found.select("row", (F.col("at") - F.col("place")).alias("start"), "size", F.col("window_id").alias("window")).distinct()
    return Leaks(hits.where(F.col("hash").isNull()).select("row", "key", "n_words"), written(spans), held)


def covered_words(spans: DataFrame) -> DataFrame:
    """row, n_hit (words in any span) and hit_spans (first and last word of each run of such words, in order)."""
    ends = spans.groupBy("row", "start").agg((F.col("start") + F.max("size")).alias("end"))
    reach = ends.selectExpr("*", "max(end) OVER (PARTITION BY row ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    runs = reach.selectExpr("row", "start", "end", "sum(if(before IS NULL OR start > before, 1, 0)) OVER (PARTITION BY row ORDER BY start) AS run")
    merged = runs.groupBy("row", "run").agg(F.min("start").alias("first"), F.max("end").alias("end"))
    last = F.sort_array(F.collect_list(F.struct("first", (F.col("end") - 1).alias("last"))))
    return merged.groupBy("row").agg(F.sum(F.expr("end - first")).alias("n_hit"), last.alias("hit_spans"))


def leaked_items(leaks: Leaks) -> DataFrame:
    """row, n_items and items (keys as strings, in order) of every document with a span.

    Documents with the same set of windows have the same items, so a passage that many documents share is looked up once.
    """
    sets = leaks.spans.groupBy("row").agg(F.sort_array(F.collect_set("window")).alias("windows"))
    signed = written(sets.withColumn("sign", F.sha2(F.col("windows").cast("string"), 256)))
    each = signed.groupBy("sign").agg(F.first("windows").alias("windows")).select("sign", F.explode("windows").alias("window"))
    items = each.join(leaks.held, "window").select("sign", F.col("item").cast("string").alias("item")).distinct()
    listed = items.groupBy("sign").agg(F.count("item").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items"))
    return hot_join(signed.select("row", "sign"), listed, "sign", "row").drop("sign")


def judge(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """One row per document: key, n_words, n_hit, hit_spans, n_items, items and contaminated; see ``find_leaks``.

    ``hit_spans`` are the first and last words (from 0) of the runs to remove, null for a clean document, like ``items``.
    """
    leaks = find_leaks(docs, items, **options)
    found = covered_words(leaks.spans).join(leaked_items(leaks), "row", "left")
    whole = leaks.docs.join(found, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")]
    return whole.select("key", "n_words", *zero, "hit_spans", "items", F.col("n_hit").isNotNull().alias("contaminated"))
