"""Connected components of a graph of any diameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators.joins import sized_join
from wattloom.session import cut_lineage


def _hop(links: DataFrame, size: int) -> DataFrame:
    ahead = links.select(F.col("u").alias("p"), F.col("p").alias("_pp"))
    return sized_join(links, ahead, "p", "u", size, "left").select("u", F.coalesce("_pp", "p").alias("p"), F.col("_pp").isNotNull().alias("_moved"))


def _shortcut(links: DataFrame, size: int) -> DataFrame:
    """Replace each target by the end of its chain; the depth halves with every hop."""
    while True:
        jumped = cut_lineage(_hop(_hop(links, size).drop("_moved"), size))
        links = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return links


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node: node, root.

    ``nodes`` has a column ``node``, ``edges`` columns ``u`` and ``v``. Each round links every node that has
    a smaller neighbour to the smallest one, follows the links to their ends and contracts the edges, so the
    number of rounds grows with the logarithm of the number of nodes. Roots of large components are hot keys;
    their rows are salted.
    """
    size = nodes.count()
    labels = nodes.select("node", F.col("node").alias("root"))
    live = cut_lineage(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = _shortcut(both.groupBy("u").agg(F.min("v").alias("p")).where("p < u"), size)
        ends = links.withColumnRenamed("u", "root")
        labels = sized_join(labels, ends, "root", "node", size, "left").select("node", F.coalesce("p", "root").alias("root"))
        for side in ("u", "v"):
            ends, other = links.select(F.col("u").alias(side), "p"), "v" if side == "u" else "u"
            live = sized_join(live, ends, side, other, size, "left").select(F.coalesce("p", side).alias(side), other)
        live = live.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        live = cut_lineage(live.distinct())
    return cut_lineage(labels)
