"""Prefix trie of conversations by union-find over sorted neighbours.

A conversation is a path: for each turn a fingerprint of role and text, and the bytes of the text. Sorted paths are cut
into ranges. In a range, the longest common prefixes (LCP) of neighbours are edges; taken from the deepest to the
shallowest, each joins the two components beside it and makes a branching node at its depth, so the nodes of the trie come
out bottom up and no prefix is ever looked up. A prefix of several ranges lies on the left or right edge of each of them:
a range gives what it knows about these nodes, everything below them contracted to sums, and these partial nodes are added
up by prefix. All sums count a node in the one range where it begins, so adding is all that merging needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.blobs import give_back
from wattloom.llm.common import small_side, written
from wattloom.operators.joins import hot_join
from wattloom.session import cut_lineage

#: Bytes of a turn in a path: 16 of the fingerprint, 4 of the text's length.
TURN = 20
#: Bytes of paths in a range, about.
RANGE = 1 << 21
#: Key numbers that are joined to one text on their way to the digest, at most.
CHUNK = 1 << 13


def _emitted(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def pack_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key`` (long) and path of each conversation.

    Turns are ordered by number, null first, equal numbers by role and fingerprint; a null role or text is empty; repeated
    rows are turns of their own. Rows without a key belong to no conversation. The texts do not leave their task, and a
    conversation of any length is gathered as it streams by, at 20 bytes a turn.
    """
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    print_ = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256)), 1, 16)
    size = F.unhex(F.lpad(F.hex(F.octet_length(said)), 8, "0"))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(turn).alias("turn"), by.alias("role"), F.concat(print_, size).alias("step"))
    dealt = rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "step").select("key", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            keys, steps = batch.column(0).to_numpy(), b"".join(batch.column(1).to_pylist())
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
            done_keys, done = [], []
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                if parts and last != keys[a]:
                    done_keys.append(last)
                    done.append(b"".join(parts))
                    parts = []
                last = keys[a]
                parts.append(steps[a * TURN:b * TURN])
            yield pa.RecordBatch.from_arrays([pa.array(done_keys, pa.int64()), pa.array(done, pa.binary())], ["key", "path"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["key", "path"])
        give_back()

    return dealt.mapInArrow(run, "key bigint, path binary").withColumnRenamed("key", key)


_RUNS = pa.schema([("path", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths and keys to (path, first key, number of keys, keys as text), a bounded number of keys at a time."""

    def rows() -> Iterator[tuple]:
        path, ids = None, []
        for batch in batches:
            for here, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (here != path or len(ids) == CHUNK):
                    yield path, ids[0], len(ids), ",".join(map(str, ids))
                    ids = []
                path = here
                ids.append(key)
        if ids:
            yield path, ids[0], len(ids), ",".join(map(str, ids))

    yield from _emitted(rows(), _RUNS, 256)
    give_back()


_ENDS = pa.schema([("path", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order to one row per path: smallest key, number and digest of all keys."""

    def rows() -> Iterator[tuple]:
        path, first, n, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            for here, key, count, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if n and here == path:
                    digest.update(b",")
                else:
                    if n:
                        yield path, first, n, digest.hexdigest()
                    path, first, n, digest = here, key, 0, hashlib.sha256()
                digest.update(ids.encode())
                n += count
        if n:
            yield path, first, n, digest.hexdigest()

    yield from _emitted(rows(), _ENDS)
    give_back()


def common_turns(a: bytes, b: bytes) -> int:
    """Number of first turns that two paths share."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])
    return (size - (differ.bit_length() + 7) // 8) // TURN


#: Columns of a node. ``up`` is the fingerprint of a parent that other ranges may know more about, else null; ``prefix`` that
#: of the node itself in this case. Numbers of a partial node are sums over its own range.
NODES = pa.schema([("prefix", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
_NODES_SQL = ("prefix binary, up binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
              "saved_tokens bigint, ends_sha256 string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def forest(paths: list[bytes], keys: np.ndarray, counts: np.ndarray, shas: list[str], left: int, right: int) -> pa.RecordBatch:
    """All nodes of sorted, distinct paths; ``left`` and ``right``: turns that the first and last share with their neighbours
    outside. Nodes down to these depths on the edges are partial, and so is the root."""
    many = len(paths)
    lcp = np.array([left, *[common_turns(a, b) for a, b in zip(paths, paths[1:], strict=False)], right], np.int64)
    depth = [len(p) // TURN for p in paths]
    # components by their leftmost path; the node on top of each; nodes from 0 to many - 1 are the ends of the paths
    home, top = list(range(many)), list(range(many))
    first, last, parent = list(range(many)), list(range(many)), [-1] * many

    def find(x: int) -> int:
        while home[x] != x:
            home[x] = home[home[x]]
            x = home[x]
        return x

    for edge in np.lexsort((np.arange(1, many), -lcp[1:-1])).tolist():
        a, b, at = find(edge), find(edge + 1), int(lcp[edge + 1])
        u, v = top[a], top[b]
        if depth[u] != at:
            node = len(depth)
            depth.append(at)
            parent.append(-1)
            first.append(first[u])
            last.append(last[v])
            parent[u] = node
            u = node
        parent[v], last[u] = u, last[v]
        home[b] = a
        top[a] = u
    if depth[top[find(0)]]:  # the root, where no edge made it
        parent[top[find(0)]] = len(depth)
        depth.append(0)
        parent.append(-1)
        first.append(0)
        last.append(many - 1)
    return _chains(paths, keys, counts, shas, lcp, *[np.array(x, np.int64) for x in (depth, parent, first, last)])


def _chains(paths: list[bytes], keys: np.ndarray, counts: np.ndarray, shas: list[str], lcp: np.ndarray,
            depth: np.ndarray, parent: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Rows of the nodes: each branching node or end stands for the chain from below its parent down to itself."""
    many, nodes = len(paths), len(depth)
    left, right = int(lcp[0]), int(lcp[-1])
    turns = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, TURN)
    steps = np.ascontiguousarray(turns[:, 16:]).view(">u4").ravel().astype(np.int64)
    begun = np.cumsum([0, *[len(p) // TURN for p in paths]])  # place of each path's first turn
    sums = np.concatenate([[0], np.cumsum(steps)])
    up = np.where(parent >= 0, depth[parent], -1)
    base = begun[first]  # a node's texts are those of its first path
    # members, smallest key and leaves from the ranges of paths below the node
    total = np.concatenate([[0], np.cumsum(counts)])
    members = total[last + 1] - total[first]
    is_leaf = np.concatenate([[0], np.cumsum(lcp[1:] < depth[:many])])
    leaves = is_leaf[last + 1] - is_leaf[first]
    lowest = keys.astype(np.int64).tolist() + [2**63 - 1] * (nodes - many)
    touches = first == 0  # may have begun in an earlier range
    known = np.where(touches, np.minimum(np.maximum(left, up), depth), up)  # turns of the chain down to here are not new
    gained = members * (sums[base + depth] - sums[base + np.maximum(up, 0)]) - (sums[base + depth] - sums[base + np.maximum(known, 0)])
    saved, children = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)  # below the node; children that are new
    for node in np.argsort(-depth, kind="stable").tolist():
        above = int(parent[node])
        if above >= 0:
            lowest[above] = min(lowest[above], lowest[node])
            saved[above] += saved[node] + gained[node]
            children[above] += int(up[node] + 1 > known[node])
    lowest = np.array(lowest, np.int64)
    # one row for each depth of each chain
    length = depth - up
    node = np.repeat(np.arange(nodes), length)
    at = up[node] + 1 + np.arange(len(node)) - np.repeat(np.cumsum(length) - length, length)
    bottom, under = at == depth[node], np.where(at == up[node] + 1, parent[node], node)  # the node that the parent row belongs to
    begin, end = base[node], sums[base[node] + depth[node]]
    saved_at = saved[node] + members[node] * (end - sums[begin + np.maximum(at - 1, 0)]) - (end - sums[begin + np.maximum(np.maximum(known[node], at - 1), 0)])
    child = np.where(bottom, children[node], (at + 1 > known[node]).astype(np.int64))

    def edges(of: np.ndarray, turns: np.ndarray) -> list[bytes | None]:
        """Fingerprint of each prefix that other ranges may share."""
        found: list[bytes | None] = [None] * len(of)
        on_left = (of >= 0) & (first[of] == 0) & (turns <= left)
        on_right = (of >= 0) & (last[of] == many - 1) & (turns <= right)
        for row in np.flatnonzero(on_left | on_right).tolist():
            found[row] = (prints[0] if on_left[row] else prints[1])[turns[row]]
        return found

    prints = [_prefix_prints(paths[0], left), _prefix_prints(paths[-1], right)]
    prefix, over = edges(node, at), edges(under, at - 1)
    ends = np.array([NO_ENDS if p is None else None for p in prefix], object)
    closed = bottom & (node < many)
    ends[closed] = np.array(shas, object)[node[closed]]
    parents = pa.array(lowest[under], mask=(at == 0) | np.array([p is not None for p in over], bool))
    return pa.RecordBatch.from_arrays([pa.array(prefix, pa.binary()), pa.array(over, pa.binary()), pa.array(at), pa.array(lowest[node]), parents, pa.array(members[node]),
                                       pa.array(child), pa.array(leaves[node]), pa.array(saved_at), pa.array(ends, pa.string())], schema=NODES)


def _prefix_prints(path: bytes, turns: int) -> list[bytes]:
    """Fingerprints of the first 0 to ``turns`` turns."""
    running, out = hashlib.sha256(), []
    for t in range(turns + 1):
        out.append(running.digest()[:16])
        running.update(path[t * TURN:(t + 1) * TURN])
    return out


def _edge_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last path of the range."""
    low = high = block = None
    for batch in batches:
        if batch.num_rows:
            low = batch.column(1)[0].as_py() if low is None else low
            high, block = batch.column(1)[-1].as_py(), batch.column(0)[0].as_py()
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([low], pa.binary()), pa.array([high], pa.binary())], ["block", "low", "high"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block, before, low, high, after = [c.to_pylist() for c in batch.columns]
        left = [common_turns(a, b) if a is not None else 0 for a, b in zip(before, low, strict=True)]
        right = [common_turns(a, b) if b is not None else 0 for a, b in zip(high, after, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["block", "left", "right"])


def trie(paths: DataFrame, key: str = "conv_id", range_bytes: int = RANGE) -> DataFrame:
    """One row per node of the trie of ``paths`` (``key`` and ``path`` as from ``pack_turns``): every distinct prefix.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of text that
    sharing the prefixes of the subtree saves) and ends_sha256 (digest of the keys of the members that end here). The root
    has depth 0 and a null parent; no paths give no rows. Equal paths are one end with several members, a repeated key
    counts each time, rows with a null key are left out. However many members an end has, their keys are joined to text
    by many tasks; only the digest reads them in a row. To the driver come two numbers for each range.
    """
    rows = paths.where(F.col(key).isNotNull()).select("path", F.col(key).cast("bigint").alias("key"))
    total = rows.agg(F.sum(F.length("path") + 24)).first()[0] or 0
    ranges = -(-total // range_bytes) or 1
    runs = written(rows.repartitionByRange(ranges, "path", "key").sortWithinPartitions("path", "key").mapInArrow(_runs, "path binary, first bigint, n bigint, ids string"))
    grouped = runs.repartitionByRange(ranges, "path").sortWithinPartitions("path", "first").mapInArrow(_ends, "path binary, key bigint, n bigint, sha string")
    ends = cut_lineage(grouped.select(F.spark_partition_id().alias("block"), "*"))
    edges = ends.select("block", "path").mapInArrow(_edge_paths, "block int, low binary, high binary")
    beside = edges.selectExpr("block", "lag(high) OVER (ORDER BY block) AS before", "low", "high", "lead(low) OVER (ORDER BY block) AS after")  # a row for each range
    shared = {r["block"]: (r["left"], r["right"]) for r in beside.mapInArrow(_shared, "block int, left bigint, right bigint").collect()}

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield forest(whole["path"].to_pylist(), whole["key"].to_numpy(), whole["n"].to_numpy(), whole["sha"].to_pylist(), *shared[whole["block"][0].as_py()])
        give_back()

    nodes = written(ends.mapInArrow(grow, _NODES_SQL))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.where("prefix IS NOT NULL").groupBy("prefix").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    merged = cut_lineage(parts.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    parents = merged.select(F.col("prefix").alias("up"), F.col("conv_id").alias("_parent"))
    sought = small_side(parents)
    hanging = nodes.where("prefix IS NULL AND up IS NOT NULL").drop("prefix", "parent_conv_id").unionByName(merged.where("up IS NOT NULL").drop("prefix"))
    joined = hanging.join(sought, "up", "left") if sought is not parents else hot_join(hanging, parents, "up", ["depth", "conv_id"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    closed = nodes.where("prefix IS NULL AND up IS NULL").select(*columns)
    root = merged.where("up IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    return closed.unionByName(joined.withColumnRenamed("_parent", "parent_conv_id").select(*columns)).unionByName(root.select(*columns))
