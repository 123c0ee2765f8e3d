"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of equal size that few edges cross. A small classifier learns the
part of a vector from the parts of its neighbours. It places every vector of the table, and sends a query to the most
probable parts; what these hold is ranked by the exact measure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut_lineage

#: Vectors that the graph and the classifier are fitted on, at most. Every vector is indexed, whatever this is.
FIT_ROWS = 8192
#: Rows of a block of candidates, and of a block of queries, about.
CANDIDATES = 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of every unit vector."""
    out = np.empty((len(vectors), k), np.int64)
    for begin in range(0, len(vectors), 1024):
        near = vectors[begin:begin + 1024] @ vectors.T
        near[np.arange(len(near)), np.arange(begin, begin + len(near))] = -np.inf
        out[begin:begin + len(near)] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _bisect(size: int, left: np.ndarray, right: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Side of each of ``size`` nodes, both of equal size: spectral order, then swaps of nodes that shorten the cut."""
    degree = np.maximum(np.bincount(left, minlength=size), 1)
    flat = np.sqrt(degree / degree.sum())
    order = rng.standard_normal(size)
    for _ in range(100):
        order -= flat * (flat @ order)
        order = order / max(np.linalg.norm(order), 1e-12)
        order = order + np.bincount(left, weights=(order / np.sqrt(degree))[right], minlength=size) / np.sqrt(degree)
    side = np.zeros(size, bool)
    side[np.argsort(order / np.sqrt(degree), kind="stable")[size // 2:]] = True
    for _ in range(10):
        across = side[left] != side[right]
        gain = np.bincount(left, weights=np.where(across, 1.0, -1.0), minlength=size)
        ones, zeros = np.flatnonzero(side), np.flatnonzero(~side)
        ones, zeros = ones[np.argsort(-gain[ones], kind="stable")], zeros[np.argsort(-gain[zeros], kind="stable")]
        pairs = min(len(ones), len(zeros))
        good = int((gain[ones[:pairs]] + gain[zeros[:pairs]] > 0).sum())
        if not good:
            break
        moved = side.copy()
        swap = max(1, good // 2)
        moved[ones[:swap]], moved[zeros[:swap]] = False, True
        if (moved[left] != moved[right]).sum() >= across.sum():
            break
        side = moved
    return side


def balanced_parts(graph: np.ndarray, depth: int, seed: int = 0) -> np.ndarray:
    """Part (0 to 2^depth - 1) of every node; sizes differ by the halving of odd numbers only."""
    count, k = graph.shape
    left = np.concatenate([np.repeat(np.arange(count), k), graph.ravel()])
    right = np.concatenate([graph.ravel(), np.repeat(np.arange(count), k)])
    part, rng = np.zeros(count, np.int64), np.random.default_rng(seed)
    for _ in range(depth):
        new = part * 2
        for p in range(part.max() + 1):
            nodes = np.flatnonzero(part == p)
            place = np.full(count, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[left] >= 0) & (place[right] >= 0)
            new[nodes] += _bisect(len(nodes), place[left[inside]], place[right[inside]], rng)
        part = new
    return part


@dataclass(frozen=True)
class Router:
    """One hidden layer and a softmax over parts; inputs are unit vectors."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def chances(self, vectors: np.ndarray) -> np.ndarray:
        hidden = np.maximum(vectors @ self.w1 + self.b1, 0)
        logits = hidden @ self.w2 + self.b2
        logits -= logits.max(axis=1, keepdims=True)
        out = np.exp(logits)
        return out / out.sum(axis=1, keepdims=True)


def fit_router(vectors: np.ndarray, depth: int, k: int = 10, hidden: int = 128, epochs: int = 40, seed: int = 0) -> Router:
    """Router fitted on a sample of vectors: graph, balanced parts, classifier on the parts of each node's neighbours."""
    rng = np.random.default_rng(seed)
    width, count = vectors.shape[1] if len(vectors) else 1, len(vectors)
    while depth and (count >> depth) < 4 * k:  # parts of a small sample still hold some neighbourhoods
        depth -= 1
    parts = 1 << depth
    weights = [rng.standard_normal((width, hidden)) * (2 / width) ** 0.5 * width ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, parts)) * 0.01, np.zeros(parts)]
    if not depth:
        return Router(*weights)
    x = unit(vectors)
    graph = neighbour_graph(x, k)
    part = balanced_parts(graph, depth, seed)
    aim = np.zeros((count, parts))
    for column in [part, *part[graph].T]:
        aim[np.arange(count), column] += 1 / (k + 1)
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(count), max(1, count // 256)):
            step += 1
            w1, b1, w2, b2 = weights
            inner = x[rows] @ w1 + b1
            hid = np.maximum(inner, 0)
            logits = hid @ w2 + b2
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=1, keepdims=True)
            error = (chance - aim[rows]) / len(rows)
            back = (error @ w2.T) * (inner > 0)
            for j, slope in enumerate((x[rows].T @ back, back.sum(axis=0), hid.T @ error, error.sum(axis=0))):
                first[j] = 0.9 * first[j] + 0.1 * slope
                second[j] = 0.999 * second[j] + 0.001 * slope**2
                weights[j] = weights[j] - 0.003 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def routes(chances: np.ndarray, sizes: np.ndarray, mass: float, least: int) -> np.ndarray:
    """Parts that each query visits: the most probable ones until their chances add up to ``mass`` and they hold ``least`` rows."""
    order = np.argsort(-chances, axis=1, kind="stable")
    ranked = np.take_along_axis(chances, order, axis=1)
    before = np.cumsum(ranked, axis=1) - ranked
    held = np.cumsum(sizes[order], axis=1) - sizes[order]
    out = np.zeros(chances.shape, bool)
    np.put_along_axis(out, order, (before < mass) | (held < least), axis=1)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products, added from the first component on: equal vectors give equal sums wherever they stand."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, candidate place and exact cosine of the k nearest of each query, ties to smaller ids."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    x = unit(vectors)
    for begin in range(0, len(queries), 256):
        near = unit(queries[begin:begin + 256]) @ x.T
        near[query_ids[begin:begin + 256, None] == ids[None, :]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(axis=1)
        row, column = np.nonzero((near >= least[:, None] - 1e-9) & np.isfinite(near))
        a, b = queries[begin + row], vectors[column]
        score = _dots(a, b) / (np.sqrt(_dots(a, a)) * np.sqrt(_dots(b, b)))
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((begin + row[rank < k], column[rank < k], score[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def search(vectors: DataFrame, queries: str = "id % 50 = 0", key: str = "vec_id", vector: str = "embedding", k: int = 5, depth: int = 5, mass: float = 0.96, fit_rows: int = FIT_ROWS, seed: int = 0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: up to ``k`` nearest rows of each row for which ``queries`` holds.

    ``queries`` is a condition on ``id``. Nearness is the cosine in double precision. The classifier is fitted on at
    most ``fit_rows`` rows, those with the smallest hashes of key and vector; all rows are indexed. A query visits the
    most probable parts until their chances add up to ``mass`` and they hold enough rows for k results. Vectors that are
    null or zero, have null or non-finite components, or have another length than most take no part, nor do null keys.
    A row is no neighbour of a row with its own key; repeated rows are candidates and queries one by one. Other columns
    are not read; an empty table gives no rows.
    """
    named = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sound = named.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    widths = sound.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths["width"] if widths else 1
    sound = sound.where(F.size("v") == width)
    sample = sound.orderBy(F.xxhash64("id", "v"), "id").limit(fit_rows).select("v").toArrow()["v"].combine_chunks()
    router = fit_router(_matrix(sample, width), depth, seed=seed)
    parts = len(router.b2)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.chances(unit(_matrix(batch.column(1), width))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["id", "v", "part"])

    index = cut_lineage(sound.mapInArrow(place, "id bigint, v array<double>, part int").withColumn("row", F.monotonically_increasing_id()))
    found = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one number for each part
    sizes = np.array([found.get(p, 0) for p in range(parts)])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            visits = routes(router.chances(unit(_matrix(batch.column(1), width))), sizes, mass, k + 1)
            at, part = np.nonzero(visits)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in batch.columns] + [pa.array(part.astype(np.int32))], ["id", "v", "row", "part"])

    routed = cut_lineage(index.where(queries).select("id", "v", "row").mapInArrow(visit, "id bigint, v array<double>, row bigint, part int"))
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = F.array(*[F.lit(max(1, -(-int(s) // CANDIDATES))) for s in sizes])
    query_blocks = F.array(*[F.lit(max(1, -(-asked.get(p, 0) // CANDIDATES))) for p in range(parts)])
    dealt = F.pmod(F.xxhash64("row"), F.col("n")).cast("int")
    left = index.withColumn("n", blocks[F.col("part")]).withColumn("block", dealt).withColumn("query_block", F.explode(F.sequence(F.lit(0), query_blocks[F.col("part")] - 1))).drop("n")
    right = routed.withColumn("n", query_blocks[F.col("part")]).withColumn("query_block", dealt).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1))).drop("n")

    def rank(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        here = [c.combine_chunks() for c in (candidates["id"], candidates["v"], wanted["id"], wanted["v"], wanted["row"])]
        ids, query_ids = here[0].to_numpy(), here[2].to_numpy()
        query, near, score = nearest(ids, _matrix(here[1], width), query_ids, _matrix(here[3], width), k)
        return pa.table({"row": here[4].to_numpy()[query], "query_id": query_ids[query], "vec_id": ids[near], "score": score})

    by = ("part", "block", "query_block")
    scored = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, "row bigint, query_id bigint, vec_id bigint, score double")
    best = scored.selectExpr("*", "row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank").where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
