"""Profiles and groups of meters."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators.cluster import cluster_kmeans, profiles, reduce_pca
from wattloom.operators.dbscan import cluster_dbscan, neighbour_counts
from wattloom.operators.windows import array_sum
from wattloom.plans.inputs import HOURLY_SPLIT_SQL, HOURLY_SQL, hourly_series, hourly_split
from wattloom.plans.registry import query, rounded, table
from wattloom.session import cut_lineage

EPS, MIN_PTS = 0.05, 5


def meter_vectors(spark, sf):
    split = hourly_split(spark, sf)
    return profiles(hourly_series(spark, sf), split.season.where(F.col("pos") < split.start.scalar()))


@query("meter_profiles", f"""
    WITH {HOURLY_SQL}, series AS (SELECT DISTINCT pos, time FROM filled), {HOURLY_SPLIT_SQL},
    p AS (SELECT meter_id, pos, ln(1 + value) AS v FROM filled WHERE pos IN (SELECT pos FROM season) AND pos < (SELECT test_start FROM start))
    SELECT meter_id, count(*) AS length, round(sum(v), 6) AS total, round(sum(v * (pos + 1)), 4) AS weighted FROM p GROUP BY 1""")
def meter_profiles(spark, sf):
    rows = meter_vectors(spark, sf)
    weighted = array_sum(F.transform("profile", lambda v, i: v * (i + 1)))
    out = rows.select("meter_id", F.size("profile").alias("length"), array_sum(F.col("profile")).alias("total"), weighted.alias("weighted"))
    return rounded(rounded(out, 6, "total"), 4, "weighted")


SQUARINGS = 13


def component_sql(k: int) -> str:
    """Eigenvector ``u`` of the largest eigenvalue ``l`` of the products ``k{k}`` between meters, by squaring them again and
    again, and the products without it."""
    last = f"s{k}_{SQUARINGS}"
    steps = "".join(f"""
    s{k}_{n + 1} AS MATERIALIZED (SELECT i, j, v / sum(v) FILTER (i = j) OVER () AS v FROM (
      SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s{k}_{n} a JOIN s{k}_{n} b ON a.j = b.i GROUP BY ALL)),""" for n in range(SQUARINGS))
    return f"""
    s{k}_0 AS MATERIALIZED (SELECT i, j, v / sum(v) FILTER (i = j) OVER () AS v FROM k{k}),{steps}
    w{k} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS u FROM {last} WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)),
    l{k} AS MATERIALIZED (SELECT sum(a.u * v * b.u) AS l FROM k{k} JOIN w{k} a ON a.i = k{k}.i JOIN w{k} b ON b.i = k{k}.j),
    sign{k} AS MATERIALIZED (SELECT arg_max(sign(x), abs(x)) AS s FROM (SELECT sum(u * v) AS x FROM c JOIN w{k} ON i = meter_id GROUP BY pos)),
    pc{k} AS (SELECT i AS meter_id, round(u * s * sqrt(l), 6) AS pc{k} FROM w{k}, sign{k}, l{k}),
    k{k + 1} AS MATERIALIZED (SELECT k.i, k.j, k.v - l * a.u * b.u AS v FROM k{k} k JOIN w{k} a ON a.i = k.i JOIN w{k} b ON b.i = k.j, l{k})"""


@query("pca_profiles", f"""
    WITH {HOURLY_SQL}, series AS (SELECT DISTINCT pos, time FROM filled), {HOURLY_SPLIT_SQL},
    c AS MATERIALIZED (SELECT meter_id, pos, ln(1 + value) - avg(ln(1 + value)) OVER (PARTITION BY pos) AS v FROM filled
      WHERE pos IN (SELECT pos FROM season) AND pos < (SELECT test_start FROM start)),
    k1 AS MATERIALIZED (SELECT a.meter_id AS i, b.meter_id AS j, sum(a.v * b.v) AS v FROM c a JOIN c b USING (pos) GROUP BY ALL),
    {component_sql(1)}, {component_sql(2)}
    SELECT meter_id, pc1, pc2 FROM pc1 JOIN pc2 USING (meter_id)""")
def pca_profiles(spark, sf):
    reduced = reduce_pca(cut_lineage(meter_vectors(spark, sf)), 2)
    return reduced.select("meter_id", F.round(F.col("reduced")[0], 6).alias("pc1"), F.round(F.col("reduced")[1], 6).alias("pc2"))


@query("kmeans_profiles")
def kmeans_profiles(spark, sf):
    return cluster_kmeans(cut_lineage(reduce_pca(cut_lineage(meter_vectors(spark, sf)), 2)), 4)


@query("kmeans_embeddings")
def kmeans_embeddings(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return cluster_kmeans(vectors, 4, key="vec_id", column="v")


def plane(spark, sf):
    """Every vector as a whole, projected on two fixed waves over its components."""
    wave = lambda f: array_sum(F.transform("embedding", lambda v, j: v.cast("double") * f(j.cast("double"))))
    return table(spark, sf, "embeddings").select("vec_id", F.round(wave(F.cos), 9).alias("x"), F.round(wave(F.sin), 9).alias("y"))


NEAR_SQL = f"""
    p AS (SELECT vec_id, round(sum(v * cos(j)), 9) AS x, round(sum(v * sin(j)), 9) AS y FROM (
          SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(unnest(range(len(embedding))) AS DOUBLE) AS j FROM embeddings) GROUP BY 1),
    n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b
          ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS!r}),
    core AS (SELECT a AS vec_id FROM n GROUP BY a HAVING count(*) >= {MIN_PTS}),
    links AS (SELECT a, b FROM n WHERE a IN (FROM core) AND b IN (FROM core))"""


@query("dbscan_core", f"WITH {NEAR_SQL} SELECT vec_id, vec_id IN (FROM core) AS core FROM p")
def dbscan_core(spark, sf):
    return neighbour_counts(plane(spark, sf), ["x", "y"], EPS, MIN_PTS, "vec_id")


@query("dbscan_clusters", f"""
    WITH RECURSIVE {NEAR_SQL},
    walk AS (SELECT vec_id AS root, vec_id AS b FROM core UNION SELECT walk.root, links.b FROM walk JOIN links ON links.a = walk.b),
    own AS (SELECT b AS vec_id, min(root) AS first FROM walk GROUP BY 1),
    numbered AS (SELECT vec_id, dense_rank() OVER (ORDER BY first) - 1 AS clust_id FROM own),
    touched AS (SELECT n.a AS vec_id, min(clust_id) AS clust_id FROM n JOIN numbered ON numbered.vec_id = n.b GROUP BY 1)
    SELECT p.vec_id, p.vec_id IN (FROM core) AS core, coalesce(o.clust_id, t.clust_id, -1) AS clust_id
    FROM p LEFT JOIN numbered o USING (vec_id) LEFT JOIN touched t USING (vec_id)""")
def dbscan_clusters(spark, sf):
    return cluster_dbscan(plane(spark, sf), ["x", "y"], EPS, MIN_PTS, "vec_id")
