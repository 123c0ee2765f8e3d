"""Removal of long repeats across documents with run-length Burrows-Wheeler indexes.

A window is a string of ``size`` bytes. Winnowing picks the places of the smallest hashes of short grams, at least one in
every window, by the window's bytes alone: equal windows pick equal grams. A gram that two documents pick is shared, and
its owner is the smallest document. Owners give the bytes around their shared grams as reference segments, which are
dealt into blocks of bounded size and indexed; the other documents stream the bytes around the same grams against the
index of the owner's block. What matches a smaller document for a whole window is marked. Windows that do not, although
their gram is shared, may still repeat in documents that are not the owner: these few are compared among themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.blobs import dealt, gathered, give_back, xxhash_long
from wattloom.llm.common import small_side, written
from wattloom.llm.rl_index import RunIndex

GRAM = 26
#: Text bytes of a group of documents, and query bytes of a part of a block, about.
HOME_BYTES, QUERY_BYTES = 4 << 20, 16 << 20
#: Pattern bytes that are streamed as one (two windows at least), and text bytes that are dealt and hashed at a time.
PIECE, SLAB, CHUNK = 256, 1 << 20, 1 << 15
#: Rows that a task holds before it deals them out, bytes of blobs that it holds to look for rows without a partner, and
#: rows that it gives at a time.
HELD_ROWS, HELD_BYTES, ROWS = 1 << 18, 64 << 20, 1 << 16
_NONE = np.uint64(2**64 - 1)
#: Kinds of the numbers in blobs: grams by bucket, shared places by home, open windows by bucket, marks by home.
_GRAMS = ("<i8", "<u2", "<u4", "<i4")
_SHARED = ("<i8", "<i4", "<i8")
_OPEN = ("<i8", "<i8", "<u2", "<i4", "<i4")
_MARKS = ("<i8", "<i4", "<i4", "<i4")
_WEIGHTS = np.random.default_rng(50).integers(1, 2**63, (2, 1 << 10), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on, put together from hashes of powers of two."""
    base, part, length = 0x9E3779B97F4A7C15, text.astype(np.uint64) + np.uint64(1), 1
    out, have = None, 0
    while True:
        if size & length:
            out = part if out is None else part[:len(text) - have - length + 1] * np.uint64(pow(base, have, 1 << 64)) + out[length:]
            have += length
        if length * 2 > size:
            return _mix(out)
        part = part[:len(part) - length] * np.uint64(pow(base, length, 1 << 64)) + part[length:]
        length *= 2


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of ``width`` values from every place on."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:len(x) - have], x[have:])
        have *= 2
    return pick(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def window_minima(text: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end (``ends``: end of the text of each place): gram hashes, starts of windows, and the
    smallest gram hash of each window."""
    grams = gram_hashes(text, GRAM)
    minima = _sliding(grams, size - GRAM + 1, np.minimum)
    starts = np.flatnonzero(np.arange(len(minima)) + size <= ends[:len(minima)])
    return grams, starts, minima[starts]


def winnow(text: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the smallest of some window; all of them on a tie."""
    picked = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
    for begin in range(0, len(text) - GRAM + 1, CHUNK):  # a chunk at a time: its numbers stay in the processor's cache
        low, high = max(begin - size + GRAM, 0), min(begin + CHUNK - 1 + size, len(text))  # all windows of the chunk's grams
        if high - low >= size:
            at, grams = _winnowed(text[low:high], ends[low:high] - low, size)
            mine = slice(*np.searchsorted(at, [begin - low, begin - low + CHUNK]))
            picked.append((at[mine] + low, grams[mine]))
    return tuple(map(np.concatenate, zip(*picked, strict=True)))


def _winnowed(text: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    grams, width = np.minimum(gram_hashes(text, GRAM), _NONE - np.uint64(1)), size - GRAM + 1
    count = len(text) - size + 1
    least = np.zeros(len(grams) + width - 1, np.uint64)  # at place w + width - 1: the minimum of window w, plus one
    np.add(_sliding(grams, width, np.minimum), np.uint64(1), out=least[width - 1:width - 1 + count], where=np.arange(size, size + count) <= ends[:count])
    reach = _sliding(least, width, np.maximum)
    at = np.flatnonzero(grams + np.uint64(1) == reach[:len(grams)])
    return at, grams[at]


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end; for every place its text, the text's end; and the first place of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return np.frombuffer(b"".join(texts), np.uint8), owner, stops[owner] if len(owner) else owner, stops - sizes


def _slabs(sizes: list[int]) -> Iterator[slice]:
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        held += size
        if held >= SLAB or k + 1 == len(sizes):
            yield slice(begin, k + 1)
            begin, held = k + 1, 0


def _pick(size: int, buckets: int):
    """Grams of every document, dealt into buckets by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), [t or b"" for t in batch.column(1).to_pylist()]
            for slab in _slabs([len(t) for t in texts]):
                text, owner, ends, first = _laid(texts[slab])
                at, grams = winnow(text, ends, size)
                grams = grams >> np.uint64(16)  # 48 bits tell grams apart well enough: what they find is compared byte by byte
                yield dealt((grams % np.uint64(buckets)).astype(np.int64), [docs[slab][owner[at]], (grams >> np.uint64(32)), grams & np.uint64(0xFFFFFFFF), at - first[owner[at]]], _GRAMS)
        give_back()

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The batches of a partition, the first ones as one; and whether that is the whole partition."""
    first, size = [], 0
    for batch in batches:
        first.append(batch)
        size += batch.nbytes
        if size > HELD_BYTES:
            break
    else:
        if first:
            yield True, pa.concat_batches(first)
        return
    for batch in itertools.chain(first, batches):
        yield False, batch


def _elsewhere(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """False only for rows whose hash no other document has: documents are compared by slots of the hashes."""
    bits = max(4, (4 * len(hashes)).bit_length())
    slot = ((hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    one = np.zeros(1 << bits, np.int32 if len(hashes) < 2**31 else np.int64)
    one[slot] = np.arange(len(slot))
    several = np.zeros(1 << bits, bool)
    several[slot[docs[one[slot]] != docs]] = True
    return several[slot]


def _cut_up(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)
    for begin in range(0, whole.num_rows, ROWS):
        yield whole.slice(begin, ROWS)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the blobs of a bucket; without the grams of one document only, if the partition can be held."""
    for whole, batch in _held(batches):
        doc, high, low, place = gathered(batch.column(0).to_pylist(), _GRAMS)
        gram = (high.astype(np.int64) << 32) | low.astype(np.int64)
        columns = [gram, doc, place]
        if whole:
            keep = np.flatnonzero(_elsewhere(gram, doc))
            columns = [c[keep] for c in columns]
        yield from _cut_up(columns, ["gram", "doc", "place"])
    give_back()


def _homes(docs: np.ndarray, homes: int) -> np.ndarray:
    """Home of each document, as ``pmod(xxhash64(doc), homes)`` gives it."""
    return xxhash_long(docs) % homes


def _dealt_home(parts: list[list[np.ndarray]], homes: int, kinds: tuple[str, ...]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return dealt(_homes(columns[0], homes), columns, kinds)


def _elect(homes: int):
    """Shared places with the owner of their gram (the smallest doc) from rows sorted by gram, doc and place, dealt to
    the homes of their documents; and how many of them ask each block, which is the home of the owner.

    Of a gram's rows only the owner's own are held until another document follows; all others stream through.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        last_gram = last_owner = None  # of a gram that is known to be shared and may go on
        for batch in batches:
            gram, doc, place = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
            if not len(gram):
                continue
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(gram))))
            owner, found = doc[starts], doc[starts] < doc[np.append(starts[1:], len(doc)) - 1]
            if last_gram is not None and gram[0] == last_gram:
                owner[0], found[0] = last_owner, True
            if found[-1]:
                held, last_gram, last_owner = [h[:0] for h in held], gram[-1], owner[-1]
            else:
                held, last_gram, last_owner = [gram[starts[-1]:], doc[starts[-1]:], place[starts[-1]:]], None, None
            keep = found[group]
            yield [doc[keep], place[keep], owner[group][keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0

        def out() -> pa.RecordBatch:
            batch = _dealt_home(parts, homes, _SHARED)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int64())], ["home", "blob", "asked"])

        counts: dict[int, int] = {}
        for part in shared(batches):
            parts.append(part)
            rows += len(part[0])
            asked, times = np.unique(_homes(part[2][part[0] != part[2]], homes), return_counts=True)
            for block, n in zip(asked.tolist(), times.tolist(), strict=True):
                counts[block] = counts.get(block, 0) + n
            if rows >= HELD_ROWS:
                yield out()
                parts, rows = [], 0
        if rows:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.nulls(len(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["home", "blob", "asked"])
        give_back()

    return run


def _variants(keys: np.ndarray, texts: list[bytes]) -> list[int]:
    """Number of each text among the different texts of its document key, in sorted order; 0 where keys are unique."""
    order = sorted(range(len(texts)), key=lambda k: (keys[k], texts[k]))
    out = [0] * len(texts)
    for before, k in zip(order, order[1:], strict=False):
        out[k] = 0 if keys[k] != keys[before] else out[before] + (texts[k] != texts[before])
    return out


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals that are sorted by their first place."""
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.append(np.flatnonzero(new)[1:], len(first)) - 1]


def _segments(size: int, homes: int):
    """Reference and query segments of a group of documents: block, doc, variant, start, bytes, anchors (null: reference)."""
    around = size - GRAM

    def run(key: tuple, texts: pa.Table, shared: pa.Table) -> pa.Table:
        docs, values = texts["doc"].to_numpy(), [t or b"" for t in texts["text"].to_pylist()]
        at, place, owner = gathered(shared["blob"].to_pylist(), _SHARED)
        order = np.lexsort((place, at))
        at, place, owner = at[order], place[order].astype(np.int64), owner[order]
        block = _homes(owner, homes)
        variants = np.array(_variants(docs, values), np.int64)
        once = np.sort(np.unique(np.stack([docs, variants]), axis=1, return_index=True)[1]) if len(docs) else np.empty(0, np.int64)
        docs, variants, values = docs[once], variants[once], [values[k] for k in once.tolist()]
        sizes = np.array([len(v) for v in values], np.int64)
        lo, hi = np.searchsorted(at, docs), np.searchsorted(at, docs, "right")
        which = np.repeat(np.arange(len(docs)), hi - lo)
        rows = np.arange(len(which)) + np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo)
        inside = place[rows] + GRAM <= sizes[which]
        which, rows = which[inside], rows[inside]
        asks = owner[rows] != docs[which]
        order = np.lexsort((place[rows], block[rows], asks, which))
        which, rows, asks = which[order], rows[order], asks[order]
        block, place = block[rows], place[rows]
        first, last = np.maximum(place - around, 0), np.minimum(place + size, sizes[which])
        new = np.ones(len(rows), bool)  # of a document's rows for a block, both ends of the intervals ascend
        new[1:] = (which[1:] != which[:-1]) | (asks[1:] != asks[:-1]) | (block[1:] != block[:-1]) | (first[1:] > last[:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(rows))[:len(starts)]
        segment = which[starts]
        parts = [values[k][x:y] for k, x, y in zip(segment.tolist(), first[starts].tolist(), last[stops - 1].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)), pa.int32()), pa.array(place - np.repeat(first[starts], stops - starts), pa.int32()), mask=pa.array(~asks[starts]))
        columns = (pa.array(block[starts], pa.int64()), pa.array(docs[segment], pa.int64()), pa.array(variants[segment], pa.int32()), pa.array(first[starts], pa.int32()), pa.array(parts, pa.binary()), lists)
        return pa.table(list(columns), names=["block", "doc", "variant", "start", "bytes", "anchors"])

    return run


def _match(size: int, buckets: int):
    """Marks, and open windows with their hashes, of the queries of a block whose references are indexed; dealt into
    buckets, open windows by hash."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table["anchors"].is_valid().to_numpy(zero_copy_only=False)
        out = [pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.bool_())], ["bucket", "blob", "marked"])]
        if is_query.any() and not is_query.all():
            references, asking = table.filter(pa.array(~is_query)), np.flatnonzero(is_query)
            index = RunIndex(references["bytes"].to_pylist(), references["doc"].to_numpy(), size)
            del references
            for slab in _slabs(pc.binary_length(table["bytes"]).to_numpy()[asking].tolist()):
                queries = table.take(asking[slab])  # a slab at a time: neither the texts nor the rows are held twice
                marks, left = _open_and_marked(index, queries, queries["bytes"].to_pylist(), size)
                for found, kinds, by in ((marks, _MARKS, xxhash_long(marks[0])), (left, _OPEN, left[1])):
                    batch = dealt(by % buckets, found, kinds)
                    out.append(pa.RecordBatch.from_arrays([*batch.columns, pa.array([kinds is _MARKS] * batch.num_rows, pa.bool_())], ["bucket", "blob", "marked"]))
            del index, queries
        give_back()
        return pa.Table.from_batches(out)

    return run


def _stream(index: RunIndex, text: np.ndarray, cuts: list[tuple[int, int]], smallest: np.ndarray) -> None:
    """Sets ``smallest`` at every place of the cuts where a whole window matches; equal pieces are streamed once."""
    data, number = text.tobytes(), {}
    which = np.array([number.setdefault(data[a:b], len(number)) for a, b in cuts], np.int64)
    starts = np.array([a for a, _ in cuts], np.int64)
    pieces = list(number)
    order = np.array(sorted(range(len(pieces)), key=lambda k: -len(pieces[k])), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_rank = np.argsort(rank[which], kind="stable")
    sorted_rank = rank[which][by_rank]
    for begin in range(0, len(order), 1 << 13):
        part = [pieces[k] for k in order[begin:begin + (1 << 13)]]
        lengths = np.array([len(p) for p in part], np.int64)
        width = len(part[0])
        patterns = np.frombuffer(b"".join(p.rjust(width, b"\0") for p in part), np.uint8).reshape(-1, width)
        found = np.full(patterns.shape, np.iinfo(np.int64).max)
        for place, lanes, rows, matched in index.matching(patterns, lengths):
            full = np.flatnonzero(matched == index.depth)
            if len(full):
                found[full, place] = index.smallest_owner(rows[full])
        lo, hi = np.searchsorted(sorted_rank, [begin, begin + len(part)])
        for block in range(lo, hi, 1 << 13):
            cut = by_rank[block:min(block + (1 << 13), hi)]
            lane = rank[which[cut]] - begin
            at, place = np.nonzero(found[lane] != np.iinfo(np.int64).max)
            smallest[starts[cut][at] + place - (width - lengths[lane[at]])] = found[lane[at], place]


def _open_and_marked(index: RunIndex, queries: pa.Table, texts: list[bytes], size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Marks (doc, variant, start, stop) and open windows (doc, two hashes, variant, start)."""
    text, owner, ends, first = _laid(texts)
    docs, variants, starts = (queries[c].to_numpy().astype(np.int64) for c in ("doc", "variant", "start"))
    smallest = np.full(len(text), np.iinfo(np.int64).max)
    piece = max(PIECE, 2 * size)
    _stream(index, text, [(a + k, min(a + k + piece, a + len(t))) for a, t in zip(first.tolist(), texts, strict=True) for k in range(0, max(1, len(t) - size + 1), piece - size + 1)], smallest)
    windows = np.flatnonzero(np.arange(len(text)) + size <= ends)
    hit = smallest[windows] < docs[owner[windows]]
    marked = windows[hit]
    new = np.flatnonzero(np.concatenate([[True], (marked[1:] != marked[:-1] + 1) | (owner[marked[1:]] != owner[marked[:-1]])])) if len(marked) else np.empty(0, np.int64)
    a, b = marked[new], marked[np.append(new[1:], len(marked)) - 1] if len(marked) else marked
    # Windows whose gram is one of the shared ones, but that the block does not hold for a smaller document.
    grams, at, minima = window_minima(text, ends, size)
    anchors = queries["anchors"].combine_chunks()
    flagged = np.full(len(grams), _NONE)
    offsets = anchors.flatten().to_numpy().astype(np.int64) + np.repeat(first, anchors.value_lengths().to_numpy())
    flagged[offsets] = grams[offsets]
    anchored = _sliding(flagged, size - GRAM + 1, np.minimum)[at] == minima
    left = at[anchored & ~(smallest[at] < docs[owner[at]])]
    one, two = np.zeros(len(left), np.uint64), np.zeros(len(left), np.uint64)
    for k in range(size):
        byte = text[left + k].astype(np.uint64) + np.uint64(1)
        one += byte * _WEIGHTS[0, k % 1024]
        two += byte * _WEIGHTS[1, k % 1024]
    one, two = _mix(one).view(np.int64), two >> np.uint64(48)
    begin = starts - first  # from the place in the slab to the place in the document
    marks = [docs[owner[a]], variants[owner[a]], a + begin[owner[a]], b + begin[owner[a]] + size]
    return marks, [docs[owner[left]], one, two, variants[owner[left]], left + begin[owner[left]]]


def _windows(size: int):
    """Rows of blobs: marks without hashes, open windows with two; without the windows of one document only, if the
    partition can be held."""
    names = ["one", "two", "doc", "variant", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, batch in _held(batches):
            is_mark = batch.column(1).to_numpy(zero_copy_only=False)
            doc, variant, start, stop = gathered(batch.column(0).filter(pa.array(is_mark)).to_pylist(), _MARKS)
            yield from _cut_up([xxhash_long(doc), np.full(len(doc), -1), doc, variant, start, stop], names)
            doc, one, two, variant, start = gathered(batch.column(0).filter(pa.array(~is_mark)).to_pylist(), _OPEN)
            columns = [one, two.astype(np.int64), doc, variant, start, start + np.int32(size)]
            if whole:
                keep = np.flatnonzero(_elsewhere(one, doc))
                columns = [c[keep] for c in columns]
            yield from _cut_up(columns, names)
        give_back()

    return run


def _settle(homes: int):
    """Marks pass; of open windows sorted by their hashes and doc, those of all but the smallest document become marks.
    All are dealt to the homes of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        parts, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, doc, variant, start, stop = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            smallest = doc[starts]
            if last and (one[0], two[0]) == last[:2]:
                smallest[0] = last[2]
            last = (one[-1], two[-1], smallest[-1])
            keep = (two < 0) | (doc > np.repeat(smallest, np.diff(np.append(starts, len(doc)))))
            parts.append([doc[keep], variant[keep], start[keep], stop[keep]])
            rows += int(keep.sum())
            if rows >= HELD_ROWS:
                yield _dealt_home(parts, homes, _MARKS)
                parts, rows = [], 0
        if rows:
            yield _dealt_home(parts, homes, _MARKS)
        give_back()

    return run


def _cut(names: list[str], characters: bool):
    """Documents with their spans and what is left of them."""

    def run(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        keys, values = docs["doc"].to_numpy(), [t or b"" for t in docs["text"].to_pylist()]
        doc, variant, first, last = gathered(marks["blob"].to_pylist(), _MARKS)
        order = np.lexsort((first, variant, doc))
        first, last = first[order].astype(np.int64), last[order].astype(np.int64)
        at = zip(doc[order].tolist(), variant[order].tolist(), strict=True)
        bounds: dict[tuple[int, int], list[int]] = {}
        for k, pair in enumerate(at):
            bounds.setdefault(pair, [k, k])[1] = k + 1
        spans, kept, removed = [], [], []
        for pair, value in zip(zip(keys.tolist(), _variants(keys, values), strict=True), values, strict=True):
            lo, hi = bounds.get(pair, (0, 0))
            a, b = _merged(first[lo:hi], last[lo:hi])
            if len(a) > 1:  # spans that touch are one run
                new = np.concatenate([[True], a[1:] > b[:-1]])
                a, b = a[new], b[np.append(np.flatnonzero(new)[1:], len(b)) - 1]
            spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(a, b, strict=True)])
            removed.append(int((b - a).sum()))
            edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(value)]
            kept.append(b"".join(value[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if len(a) else value)
        if characters:
            kept = [v.decode(errors="ignore").encode() for v in kept]
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        new = {"_bytes": pa.array([len(v) for v in values], pa.int64()), "_removed": pa.array(removed, pa.int64()), "_spans": pa.array(spans, span), "_kept": pa.array(kept, pa.binary())}
        return pa.table({**{n: docs[n] for n in names}, **new})

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 50, characters: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, with n_bytes, n_removed, n_spans, spans (array of start, stop) and kept (binary).

    Texts are UTF-8 bytes, null is empty. Every byte is removed that lies in a string of ``size`` bytes which also starts
    in a document with a smaller key; strings are judged on the input and never cross documents. A null key is larger
    than any other, and neither null nor equal keys are smaller than one another: repeated rows with equal keys both stay.
    Texts shorter than ``size`` and empty ones stay whole. Columns of ``docs`` with the names of new ones are replaced. An
    empty table gives no rows. With ``characters``, kept also lacks the bytes of characters that a span cuts apart, so that
    it is text again; the counts and spans are the same. Windows that no index settles are compared by 80 bits of hashes. ``size`` is from 32 to 1024.
    """
    new = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
    names = [c for c in docs.columns if c != text and c not in new]
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)], F.coalesce(F.col(key).cast("bigint"), F.lit(2**63 - 1)).alias("doc"), F.col(text).cast("binary").alias("text"))
    homes = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // HOME_BYTES
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = rows.select("doc", "text").mapInArrow(_pick(size, buckets), "key bigint, blob binary").repartition("key").select("blob")
    sorted_grams = grams.mapInArrow(_grams, "gram bigint, doc bigint, place int").sortWithinPartitions("gram", "doc")
    shared = written(sorted_grams.mapInArrow(_elect(homes), "home bigint, blob binary, asked bigint"))
    # A query segment adds about half a window for each of its places.
    salts = F.ceil(F.sum("asked") * size / 2 / QUERY_BYTES).cast("int")
    salts = written(shared.where("asked IS NOT NULL").groupBy(F.col("home").alias("block")).agg(salts.alias("salts")))
    texts = rows.withColumn("home", F.pmod(F.xxhash64("doc"), F.lit(homes))).groupBy("home")
    segments = texts.cogroup(shared.where("blob IS NOT NULL").select("home", "blob").groupBy("home")).applyInArrow(_segments(size, homes), "block bigint, doc bigint, variant int, start int, bytes binary, anchors array<int>")
    salt = F.when(F.col("anchors").isNull(), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc", "variant", "start"), F.col("salts")).cast("int")))
    laid = segments.join(small_side(salts), "block").withColumn("salt", F.explode(salt)).drop("salts")
    matched = laid.groupBy("block", "salt").applyInArrow(_match(size, buckets), "bucket bigint, blob binary, marked boolean")
    windows = matched.repartition("bucket").select("blob", "marked").mapInArrow(_windows(size), "one bigint, two bigint, doc bigint, variant int, start int, stop int")
    marks = windows.sortWithinPartitions("one", "two", "doc").mapInArrow(_settle(homes), "home bigint, blob binary")
    columns = [f"c{k}" for k in range(len(names))]
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns]
    cut = texts.cogroup(marks.groupBy("home")).applyInArrow(_cut(columns, characters), ", ".join([*fields, "_bytes bigint, _removed bigint, _spans array<struct<start: bigint, stop: bigint>>, _kept binary"]))
    return cut.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.col("_bytes").alias("n_bytes"), F.col("_removed").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.col("_spans").alias("spans"), F.col("_kept").alias("kept"))
