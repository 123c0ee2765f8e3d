"""Run-length compressed Burrows-Wheeler index with matching statistics, in numpy.

The index of a block of segments keeps the runs of the transform: first row, symbol, shift of the last-to-first mapping,
and the text positions at both ends of a run. Matching statistics are streamed from right to left, for many patterns in
step: while the next symbol is that of the current run, the match is extended by one mapping; else it moves to the
nearest run end with that symbol, above or below, whichever shares more with the current match.
"""

from __future__ import annotations

import numpy as np

#: Up to this many symbols, two ranks and a position (or the first symbols and a position) fit into one 64-bit number.
PACKED = (1 << 21) - 2
#: Rows of the index that are compared with their successors at a time.
ROWS = 1 << 17


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes; the last symbol must be smaller than, or different from, all others."""
    used = np.zeros(int(symbols.max()) + 1, bool)
    used[symbols] = True
    kind = _kind(len(symbols))
    return doubled((np.cumsum(used, dtype=kind) - kind(1))[symbols], 1)


def first_ranks(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the suffixes by as many symbols as fit into one sort, and that number. Of segments laid end to end, each
    with an end of its own; ends are smaller than bytes, and among themselves ordered by place. ``left``: bytes up to it."""
    used = np.zeros(256, bool)
    used[text[left > 0]] = True
    codes, bits = np.cumsum(used).astype(np.uint16)[text], int(used.sum()).bit_length() or 1
    step = min(8, 43 // bits, len(text))
    keys = np.zeros(len(text), np.uint64)
    for k in range(step):
        keys <<= np.uint64(bits)
        keys[:len(text) - k] |= codes[k:] * (left[:len(text) - k] > k)
    keys <<= np.uint64(21)
    keys |= np.arange(len(text), dtype=np.uint32)
    keys.sort()
    order = (keys & np.uint64((1 << 21) - 1)).astype(np.int32)
    keys >>= np.uint64(21)
    new = np.zeros(len(text), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (left[order[1:]] < step)  # up to an end: equal but for the ends
    rank = np.empty(len(text), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank, step


def doubled(rank: np.ndarray, step: int) -> np.ndarray:
    """Sorted suffixes by prefix doubling, from their dense ranks by ``step`` symbols."""
    count = len(rank)
    kind = _kind(count)
    place, bits = np.arange(count, dtype=np.uint32 if kind is np.int32 else np.uint64), np.uint64(21)
    packs = count <= PACKED
    while True:
        pair = rank.astype(np.uint64)
        pair <<= bits if packs else np.uint64(32)
        if step < count:
            pair[:count - step] += (rank[step:] + kind(1)).view(np.uint32 if kind is np.int32 else np.uint64)
        if packs:
            pair <<= bits
            pair |= place
            pair.sort()
            order = (pair & np.uint64((1 << 21) - 1)).astype(kind)
            pair >>= bits
        else:
            order = np.argsort(pair).astype(kind)
            pair = pair[order]
        new = np.zeros(count, bool)
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        del pair
        rank[order] = np.cumsum(new, dtype=kind)
        step *= 2
        if np.count_nonzero(new) == count - 1:
            return order


def _kind(count: int) -> type:
    """Places and ranks take half the memory where they fit into 32 bits."""
    return np.int32 if count < 2**31 - 1 else np.int64


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, the first one lowest."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(len(text), "<u8", padded, strides=(1,)).copy()


class RunIndex:
    """Index of ``segments`` (bytes) with an owner number each; matches are followed up to ``depth`` bytes."""

    def __init__(self, segments: list[bytes], owners: np.ndarray, depth: int):
        sizes = np.array([len(s) for s in segments], np.int64)
        text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        count = len(segments)
        kind = _kind(len(text))
        segment = np.repeat(np.arange(count, dtype=kind), sizes + 1)
        self.left = ends.astype(kind)[segment] - np.arange(len(text), dtype=kind)  # bytes up to the end of the segment
        if len(text) <= PACKED:
            order = doubled(*first_ranks(text, self.left))
        else:
            symbols = text.astype(kind) + kind(count)
            symbols[ends] = np.arange(count)  # every segment ends in a symbol of its own
            order = suffix_array(symbols)
            del symbols
        self.depth = depth
        self.words = _words(text)
        head = text[order - 1].astype(np.int16)  # the transform
        head[self.left[order - 1] == 0] = -1  # an end
        counts = np.bincount(text, minlength=256) - np.bincount(text[ends], minlength=256)
        starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        self.starts, self.heads = starts, head[starts].astype(np.int64)
        lasts = np.append(starts[1:], len(head)) - 1
        lengths = lasts - starts + 1
        del head
        first = count + np.concatenate([[0], np.cumsum(counts)[:-1]])  # first row of each byte
        by_head = np.argsort(self.heads, kind="stable")
        grouped = self.heads[by_head]
        within = np.cumsum(lengths[by_head]) - lengths[by_head]
        opening = np.searchsorted(grouped, grouped)
        within = within - within[opening]
        self.shift = np.zeros(len(starts), np.int64)
        self.shift[by_head] = first[np.maximum(grouped, 0)] + within - starts[by_head]
        self.at_first, self.at_last = order[starts].astype(np.int64), order[lasts].astype(np.int64)  # sampled run ends
        self.lasts = lasts
        self.run_of = np.repeat(np.arange(len(starts), dtype=kind), lengths)  # run of each row
        self.run_key = grouped * len(starts) + by_head  # runs by symbol, then by row
        self.by_head = by_head
        opens = np.ones(len(order), bool)
        for begin in range(1, len(order), ROWS):
            here = order[begin - 1:begin + ROWS]
            opens[begin:begin + ROWS] = self.common(here[1:], here[:-1], np.full(len(here) - 1, depth)) < depth
        self.class_of = np.cumsum(opens, dtype=kind) - kind(1)  # rows that agree in ``depth`` bytes
        self.smallest = np.minimum.reduceat(owners[segment[order]], np.flatnonzero(opens))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b`` within their segments, at most ``most``."""
        most = np.minimum(most, np.minimum(self.left[a], self.left[b]))
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        a, b, rest, done = a[live], b[live], most[live], 0
        top = len(self.words) - 1
        while len(live):
            differ = self.words[np.minimum(a + done, top)] ^ self.words[np.minimum(b + done, top)]
            equal = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            out[live] = done + equal
            done += 8
            more = np.flatnonzero((equal == 8) & (rest > done))
            live, a, b, rest = live[more], a[more], b[more], rest[more]
        return np.minimum(out, most)

    def matching(self, patterns: np.ndarray, lengths: np.ndarray):
        """Streams (place, lanes, rows, lengths of match up to ``depth``), from the last place of the patterns to the first.

        ``patterns`` has a row per pattern, aligned at the right; rows are sorted by length, longest first.
        """
        width, runs, columns = patterns.shape[1], len(self.starts), np.ascontiguousarray(patterns.T)
        row, at, match = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.at_first[0]), np.zeros(len(patterns), np.int64)
        for place in range(width - 1, -1, -1):
            lanes = int(np.searchsorted(-lengths, place - width, "right"))  # lengths >= width - place
            symbol = columns[place, :lanes].astype(np.int64)
            run = self.run_of[row[:lanes]]
            stay = self.heads[run] == symbol
            go = np.flatnonzero(~stay)
            if len(go):
                wanted, here, have = symbol[go], at[go], match[go]
                slot = np.searchsorted(self.run_key, wanted * runs + run[go].astype(np.int64))
                up, down = np.maximum(slot - 1, 0), np.minimum(slot, runs - 1)
                up, down = self.by_head[up], self.by_head[down]
                has_up, has_down = (slot > 0) & (self.heads[up] == wanted), (slot < runs) & (self.heads[down] == wanted)
                most = np.minimum(have, self.depth - 1)
                ends = np.concatenate([self.at_last[up], self.at_first[down]])
                share = self.common(np.concatenate([here, here]), ends, np.concatenate([most, most]))
                share[~np.concatenate([has_up, has_down])] = -1
                share_up, share_down = share[:len(go)], share[len(go):]
                above = share_up >= share_down
                run[go] = np.where(above, up, down)
                row[go] = np.where(above, self.lasts[up], self.starts[down])
                at[go] = np.where(above, self.at_last[up], self.at_first[down])
                match[go] = np.maximum(share_up, share_down)
            known = match[:lanes] >= 0  # the symbol occurs
            row[:lanes] = np.where(known, row[:lanes] + self.shift[run], 0)
            at[:lanes] = np.where(known, at[:lanes] - 1, self.at_first[0])
            match[:lanes] = np.where(known, np.minimum(match[:lanes] + 1, self.depth), 0)
            yield place, lanes, row[:lanes], match[:lanes]

    def smallest_owner(self, rows: np.ndarray) -> np.ndarray:
        """Smallest owner of the ``depth`` bytes that a full match at each row stands for."""
        return self.smallest[self.class_of[rows]]
