"""Neighbour search: recall, exact scores, ties and edge cases."""

import math

import numpy as np
import pytest

from wattloom.llm.neighbour_routes import balanced_parts, fit_router, nearest, neighbour_graph, routes, search, unit


def brute(ids, vectors, query, k):
    x = unit(vectors)
    score = x @ x[query]
    order = sorted((j for j in range(len(ids)) if ids[j] != ids[query]), key=lambda j: (-round(score[j], 12), ids[j]))
    return [ids[j] for j in order[:k]]


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 16)) * 4
    x = unit(centres[np.arange(800) % 8] + rng.standard_normal((800, 16)))
    graph = neighbour_graph(x, 8)
    part = balanced_parts(graph, 3)
    assert set(np.bincount(part)) == {100}
    assert (part[graph] != part[:, None]).mean() < 0.05


def test_routes_hold_enough_rows():
    visits = routes(np.array([[0.9, 0.06, 0.04], [0.4, 0.35, 0.25]]), np.array([2, 9, 1]), 0.5, 6)
    assert visits.tolist() == [[True, True, False], [True, True, False]]
    assert routes(np.array([[0.6, 0.4]]), np.array([1, 1]), 0.5, 6).all()


def test_nearest_breaks_ties_by_id():
    x = np.array([[1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [3.0, -1.0]])
    query, place, score = nearest(np.array([9, 4, 7, 1]), x, np.array([9]), x[:1], 2)
    assert place.tolist() == [1, 2] and score.tolist() == [1.0, 1.0] or score[0] == score[1]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 32)) * 0.7
    x = centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 32))
    df = spark.createDataFrame([(int(k), [float(c) for c in v], 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, rank int").repartition(4)
    out = search(df, "id % 50 = 0", k=5, depth=4, fit_rows=1500).collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(found) == list(range(0, 3000, 50)) and all(sorted(f) == [1, 2, 3, 4, 5] for f in found.values())
    ids, hits = list(range(3000)), 0
    for q, f in found.items():
        hits += len({v for v, _ in f.values()} & set(brute(ids, x, q, 5)))
        for v, s in f.values():
            dot, a, b = (sum(p * r for p, r in zip(l, m)) for l, m in ((x[q], x[v]), (x[q], x[q]), (x[v], x[v])))
            assert s == pytest.approx(dot / (math.sqrt(a) * math.sqrt(b)), abs=1e-13)
        scores = [f[k][1] for k in range(1, 6)]
        assert scores == sorted(scores, reverse=True)
    assert hits / (5 * len(found)) >= 0.9


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 3.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]),
            (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, None), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = search(df, "id % 50 = 0", k=5).collect()
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {0, 50}
    assert sorted(by[0]) == sorted([(1, 1, 1.0), (2, 2, 1.0), (3, 50, 0.0)] * 2)  # a repeated row is a query of its own
    assert [(r, v) for r, v, _ in sorted(by[50])] == [(1, 0), (2, 0), (3, 1), (4, 2)]
    assert search(df.where("false")).count() == 0
    assert search(df.where("vec_id = 50")).count() == 0


def test_router_of_a_tiny_sample():
    assert fit_router(np.ones((3, 4)), 5).chances(np.ones((2, 4))).tolist() == [[1.0], [1.0]]
    assert fit_router(np.empty((0, 1)), 5).chances(np.ones((1, 1))).tolist() == [[1.0]]
