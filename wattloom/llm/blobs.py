"""Many small rows as one: columns of numbers with a common key, packed so that they compress well on the way."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system. Python workers serve one stage after another, and what the allocators of one
    hold back would count against the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def packed(columns: Sequence[np.ndarray]) -> bytes:
    """Columns one after the other, each as its lowest bytes, then its next ones, and so on."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns)


def unpacked(blob: bytes, kinds: Sequence[str]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    count, at, out = len(blob) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        planes = np.frombuffer(blob, np.uint8, count * size, at).reshape(size, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += count * size
    return out


def dealt(key: np.ndarray, columns: Sequence[np.ndarray], kinds: Sequence[str]) -> pa.RecordBatch:
    """A row (key, blob) for each key. The first column is sorted within a key and kept as differences."""
    first = columns[0]
    order = np.arange(len(first)) if len(first) < 2 or (first[1:] >= first[:-1]).all() else np.argsort(first, kind="stable")
    if len(key) and 0 <= key.min() and key.max() < 1 << 16:
        key = key.astype(np.uint16)  # sorted by its digits
    order = order[np.argsort(key[order], kind="stable")]
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    first = columns[0][order].astype(np.int64)
    steps = np.diff(first, prepend=0)
    steps[starts] = first[starts]
    sorted_ = [steps, *[c[order] for c in columns[1:]]]
    sorted_ = [c.astype(k) for c, k in zip(sorted_, ["<i8", *kinds[1:]], strict=True)]
    ends = np.append(starts[1:], len(key))[:len(starts)]
    blobs = [packed([c[a:b] for c in sorted_]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(key[starts].astype(np.int64)), pa.array(blobs, pa.binary())], ["key", "blob"])


def gathered(blobs: Sequence[bytes], kinds: Sequence[str]) -> list[np.ndarray]:
    """Columns of all rows of the blobs that ``dealt`` made."""
    parts = []
    for blob in blobs:
        part = unpacked(blob, ["<i8", *kinds[1:]])
        part[0] = np.cumsum(part[0])
        parts.append(part)
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, kind) for k, kind in enumerate(kinds)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of eight-byte numbers, as the SQL function xxhash64 gives it."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        mixed = _turned(values.astype(np.int64).view(np.uint64) * two, 31) * one
        out = _turned(mixed ^ (np.uint64(seed) + five + np.uint64(8)), 27) * one + four
        out = (out ^ (out >> np.uint64(33))) * two
        out = (out ^ (out >> np.uint64(29))) * three
        return (out ^ (out >> np.uint64(32))).view(np.int64)
