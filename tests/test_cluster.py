import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wattloom.operators import cluster as cl
from wattloom.operators import dbscan as db
from wattloom.operators import joins
from wattloom.operators.components import components


def points_of(spark, xy):
    names = [f"x{j}" for j in range(xy.shape[1])]
    data = [(i, *map(float, p)) for i, p in enumerate(xy)]
    return spark.createDataFrame(data, "meter_id long, " + ", ".join(f"{n} double" for n in names)), names


def dbscan_by_hand(xy, eps, min_pts):
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_pts
    labels, n = np.full(len(xy), -1), 0
    for i in range(len(xy)):
        if not core[i] or labels[i] >= 0:
            continue
        stack = [i]
        while stack:
            p = stack.pop()
            for q in np.flatnonzero(near[p] & (labels < 0)):
                labels[q] = n
                if core[q]:
                    stack.append(q)
        n += 1
    return core, labels


def agree(spark, xy, eps, min_pts):
    df, names = points_of(spark, xy)
    got = db.cluster_dbscan(df, names, eps, min_pts).toPandas().sort_values("meter_id")
    core, labels = dbscan_by_hand(xy, eps, min_pts)
    assert got["core"].tolist() == core.tolist()
    assert got["clust_id"].tolist() == labels.tolist()
    return labels


def test_two_blobs_and_a_far_point(spark):
    rng = np.random.default_rng(0)
    xy = np.vstack([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), [[50, 50]]])
    labels = agree(spark, xy, 0.5, 5)
    assert set(labels) == {0, 1, -1} and labels[-1] == -1


def test_matches_all_pairs_in_two_and_three_dimensions(spark):
    rng = np.random.default_rng(4)
    agree(spark, rng.uniform(0, 10, (150, 2)), 0.7, 4)
    agree(spark, rng.uniform(0, 4, (120, 3)), 0.8, 5)


def test_crowded_cells_are_cut_into_boxes(spark, monkeypatch):
    """Two crowded cells side by side, with copies; all pairs of boxes must be refined."""
    monkeypatch.setattr(db, "DIRECT_PAIRS", 4)
    monkeypatch.setattr(joins, "HOT", 10)
    rng = np.random.default_rng(7)
    left = rng.uniform([0.0, 0.0], [0.3, 0.7], (60, 2))
    for gap in (0.95, 1.15):
        right = rng.uniform([0.3 + gap, 0.0], [0.6 + gap, 0.7], (60, 2))
        copies = np.repeat(left[:1], 40, axis=0)
        labels = agree(spark, np.vstack([left, right, copies]), 1.0, 5)
        assert len(set(labels)) == (1 if gap < 1 else 2)


def test_copies_count_towards_core(spark):
    xy = np.array([[0.0, 0.0]] * 5 + [[0.4, 0.0], [9.0, 9.0]])
    assert agree(spark, xy, 0.5, 5).tolist() == [0] * 6 + [-1]


def test_dbscan_rejects_many_dimensions(spark):
    df, names = points_of(spark, np.zeros((2, 4)))
    with pytest.raises(ValueError):
        db.cluster_dbscan(df, names, 1.0)


def test_components_with_hot_roots(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 2)
    edges = spark.createDataFrame([(1, i) for i in range(2, 12)] + [(20, 21), (12, 11)], "u long, v long")
    nodes = spark.range(30).withColumnRenamed("id", "node")
    got = {r.node: r.root for r in components(nodes, edges).collect()}
    assert got == {n: 1 if 1 <= n <= 12 else 20 if n == 21 else n for n in range(30)}


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(200)
    edges = [(int(a), int(b)) for a, b in zip(order[:120], order[1:120])] + [(int(order[150]), int(order[160]))]
    nodes = spark.createDataFrame([(int(i),) for i in range(200)], "node long")
    got = {r.node: r.root for r in components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    chain = {int(i) for i in order[:120]}
    assert all(got[i] == min(chain) for i in chain)
    assert got[int(order[160])] == got[int(order[150])] == min(int(order[150]), int(order[160]))
    assert got[int(order[170])] == int(order[170]) and len(got) == 200


def vectors_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "meter_id long, profile array<double>")


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(2).normal(size=(40, 12)) @ np.diag(np.linspace(5, 0.5, 12)) + 3
    got = cl.reduce_pca(vectors_of(spark, x), 2).orderBy("meter_id").toPandas()["reduced"]
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes = np.array([a if a[np.abs(a).argmax()] > 0 else -a for a in axes])
    np.testing.assert_allclose(np.stack(got), centred @ axes.T, atol=1e-8)


def test_profiles_and_kmeans(spark):
    data = [(m, p, float((m // 5) * 50 + p % 3 + m % 5)) for m in range(10) for p in range(20)]
    series = spark.createDataFrame(data, "meter_id long, pos long, value double")
    made = cl.profiles(series, spark.range(4, 16).withColumnRenamed("id", "pos"))
    first = made.where("meter_id = 7").first().profile
    np.testing.assert_allclose(first, [np.log1p(50 + p % 3 + 2) for p in range(4, 16)])
    labels = dict(rows(cl.cluster_kmeans(cl.reduce_pca(made, 2), 2).select("meter_id", "clust_id"), "meter_id"))
    assert [labels[m] for m in range(10)] == [0] * 5 + [1] * 5


def test_relabel(spark):
    df = spark.createDataFrame([(1, 7), (2, 3), (3, 7), (0, 5)], "meter_id int, clust_id int")
    assert rows(cl.relabel(df).select("meter_id", "clust_id"), "meter_id") == [(0, 0), (1, 1), (2, 2), (3, 1)]


def test_kmeans_does_not_depend_on_partitions(spark):
    xy = np.random.default_rng(4).normal(size=(300, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(xy)], "meter_id long, reduced array<double>")
    found = [rows(cl.cluster_kmeans(df.repartition(n), 5).select("meter_id", "clust_id"), "meter_id") for n in (2, 7)]
    assert found[0] == found[1] and len({c for _, c in found[0]}) == 5


def test_meters_without_values_have_no_profile(spark):
    series = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, None), ("b", 1, None)], "meter_id string, pos long, value double")
    train = spark.range(2).withColumnRenamed("id", "pos")
    assert [r.meter_id for r in cl.profiles(series, train).collect()] == ["a"]
    assert [r.meter_id for r in cl.meters_without_values(series).collect()] == ["b"]


def test_reduced_vectors_of_low_rank(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(4)], "meter_id long, profile array<double>")
    got = [r.reduced for r in cl.reduce_pca(df, 2).orderBy("meter_id").collect()]
    assert np.allclose([g[1] for g in got], 0) and np.allclose(np.diff([g[0] for g in got]), 5**0.5)
