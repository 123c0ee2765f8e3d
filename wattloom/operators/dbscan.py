"""Density clusters in up to three dimensions, exact, without comparing all pairs.

Equal points are merged first. Space is cut into cells whose diagonal is eps, so all points of one cell
are neighbours: a cell with min_pts points makes all of them core, without any comparison, and all core
points of a cell share a cluster. Distances are needed only

* for points in cells with fewer than min_pts points, against the cells around them. A cell of any size
  meets a bounded number of such points, so the comparisons grow linearly with the points;
* to decide whether two neighbouring cells hold core points within eps. Large cells are cut into smaller
  boxes first, and only boxes that are neither surely near nor surely apart are cut further.

Clusters are components of the graph of cells. Rows of crowded cells are spread by joins that salt hot keys.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.operators.components import components
from wattloom.operators.joins import sized_join
from wattloom.operators.ordered import number_block, positions
from wattloom.session import cut_lineage

NOISE = -1
MAX_DIMENSIONS = 3
DIRECT_PAIRS = 4096
CUT = 4


def _offsets(d: int, half: bool = False) -> list[tuple[int, ...]]:
    """Steps to the cells that may hold points within eps; ``half`` keeps one of each opposite pair."""
    near = [o for o in itertools.product(range(-2, 3), repeat=d)
            if sum(max(abs(s) - 1, 0) ** 2 for s in o) <= d]
    return [o for o in near if o > (0,) * d] if half else near


def _around(cells: Sequence[str], offsets: list[tuple[int, ...]], prefix: str) -> Column:
    steps = [F.struct(*[(F.col(c) + s).alias(f"{prefix}{j}") for j, (c, s) in enumerate(zip(cells, o))]) for o in offsets]
    return F.explode(F.array(*steps))


class _Grid:
    def __init__(self, points: DataFrame, columns: Sequence[str], eps: float, min_pts: int):
        self.d = len(columns)
        if not 1 <= self.d <= MAX_DIMENSIONS:
            raise ValueError(f"between 1 and {MAX_DIMENSIONS} dimensions, got {self.d}; reduce the features first")
        if eps <= 0 or min_pts < 1:
            raise ValueError("eps and min_pts must be positive")
        self.eps, self.min_pts = eps, min_pts
        self.xs = [f"_x{j}" for j in range(self.d)]
        self.cs = [f"_c{j}" for j in range(self.d)]
        self.qs = [f"_q{j}" for j in range(self.d)]
        self.side = eps / math.sqrt(self.d) * (1 - 1e-9)
        spots = points.groupBy(*self.xs).agg(F.count("*").alias("_w"))
        self.spots = cut_lineage(spots.withColumns(
            {c: F.floor(F.col(x) / self.side) for c, x in zip(self.cs, self.xs)}))
        sizes = self.spots.groupBy(*self.cs).agg(F.count("*").alias("n"), F.max("_w").alias("w"))
        self.largest, self.copies = (n or 0 for n in sizes.agg(F.max("n"), F.max("w")).first())

    def near(self) -> Column:
        square = sum(((F.col(q) - F.col(x)) * (F.col(q) - F.col(x)) for q, x in zip(self.qs, self.xs)), F.lit(0.0))
        return square <= self.eps * self.eps

    def neighbours(self, asked: DataFrame, spots: DataFrame) -> DataFrame:
        """Pairs of an asked spot (coordinates ``_q*``) and a spot within eps of it."""
        queries = asked.select(*[F.col(x).alias(q) for x, q in zip(self.xs, self.qs)],
                               _around(self.cs, _offsets(self.d), "_c").alias("_n"))
        queries = queries.select(*self.qs, "_n.*")
        return sized_join(spots, queries, self.cs, self.xs, self.largest).where(self.near())

    def core_flags(self) -> DataFrame:
        """Spots with ``core`` and ``crowded``, whether their own cell makes them core."""
        cells = self.spots.groupBy(*self.cs).agg((F.sum("_w") >= self.min_pts).alias("crowded"))
        spots = sized_join(self.spots, cells, self.cs, self.xs, self.largest)
        few = spots.where("not crowded")
        counted = self.neighbours(few, self.spots).groupBy(*self.qs).agg((F.sum("_w") >= self.min_pts).alias("_k"))
        counted = counted.withColumnsRenamed(dict(zip(self.qs, self.xs)))
        flagged = few.join(counted, self.xs).withColumn("core", F.col("_k")).drop("_k")
        return cut_lineage(spots.where("crowded").withColumn("core", F.lit(True)).unionByName(flagged))

    def node(self, prefix: str = "_c") -> Column:
        return F.concat_ws(":", *[F.col(f"{prefix}{j}").cast("string") for j in range(self.d)])

    def boxes(self, core: DataFrame, level: int) -> DataFrame:
        """Core spots summarised in boxes: node, box, count and bounds per dimension."""
        width = self.side / CUT ** level
        box = F.lit("") if level == 0 else F.concat_ws(":", *[F.floor(F.col(x) / width).cast("string") for x in self.xs])
        bounds = [b for j, x in enumerate(self.xs) for b in (F.min(x).alias(f"lo{j}"), F.max(x).alias(f"hi{j}"))]
        return core.groupBy("node", box.alias("box")).agg(F.count("*").alias("n"), *bounds)

    def decide(self, pairs: DataFrame, boxes: DataFrame) -> DataFrame:
        """Pairs of boxes with ``near``: true, false, or null while undecided."""
        for side in ("a", "b"):
            named = boxes.select(F.col("node").alias(f"{side}_node"), F.col("box").alias(f"{side}_box"), *[
                F.col(c).alias(f"{side}_{c}") for c in boxes.columns if c not in ("node", "box")])
            pairs = pairs.join(named, [f"{side}_node", f"{side}_box"])
        least, most = F.lit(0.0), F.lit(0.0)
        for j in range(self.d):
            alo, ahi, blo, bhi = (F.col(f"{s}_{e}{j}") for s in "ab" for e in ("lo", "hi"))
            gap = F.greatest(blo - ahi, alo - bhi, F.lit(0.0))
            span = F.greatest(bhi - alo, ahi - blo)
            least, most = least + gap * gap, most + span * span
        limit = self.eps * self.eps
        return pairs.select(
            "a_node", "a_box", "b_node", "b_box", "a_n", "b_n",
            F.when(most <= limit, True).when(least > limit, False).alias("near"))

    def edges(self, core: DataFrame) -> DataFrame:
        """Neighbouring cells that hold core points within eps of each other: u, v."""
        cells = core.select(*self.cs, "node").distinct()
        ahead = cells.select(F.col("node").alias("a_node"), _around(self.cs, _offsets(self.d, half=True), "_c").alias("_n"))
        met = ahead.select("a_node", "_n.*").join(cells.withColumnRenamed("node", "b_node"), self.cs)
        pairs = met.select("a_node", F.lit("").alias("a_box"), "b_node", F.lit("").alias("b_box"))
        level, found = 0, []
        while True:
            boxes = self.boxes(core, level)
            judged = cut_lineage(self.decide(pairs, boxes))
            linked = judged.where("near").select("a_node", "b_node").distinct()
            undecided = judged.where("near is null").join(linked, ["a_node", "b_node"], "left_anti")
            small = F.col("a_n") * F.col("b_n") <= DIRECT_PAIRS
            met = self.compare(undecided.where(small), core, level)
            met = cut_lineage(linked.unionByName(met).distinct())
            found.append(met)
            rest = undecided.where(~small).join(met, ["a_node", "b_node"], "left_anti").select("a_node", "a_box", "b_node", "b_box")
            rest = cut_lineage(rest)
            if rest.isEmpty():
                break
            pairs = self.refine(rest, core, level)
            level += 1
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        return whole.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct()

    def boxed(self, core: DataFrame, level: int, side: str) -> DataFrame:
        width = self.side / CUT ** level
        box = F.lit("") if level == 0 else F.concat_ws(":", *[F.floor(F.col(x) / width).cast("string") for x in self.xs])
        return core.select(F.col("node").alias(f"{side}_node"), box.alias(f"{side}_box"), *self.xs)

    def compare(self, pairs: DataFrame, core: DataFrame, level: int) -> DataFrame:
        """Pairs of boxes, at most DIRECT_PAIRS points to compare each, that hold points within eps."""
        left = self.boxed(core, level, "a").withColumnsRenamed(dict(zip(self.xs, self.qs)))
        right = self.boxed(core, level, "b")
        keys = pairs.select("a_node", "a_box", "b_node", "b_box")
        both = keys.join(left, ["a_node", "a_box"]).join(right, ["b_node", "b_box"])
        return both.where(self.near()).select("a_node", "b_node").distinct()

    def refine(self, pairs: DataFrame, core: DataFrame, level: int) -> DataFrame:
        """The same pairs one level further down."""
        width, finer = self.side / CUT ** level, self.side / CUT ** (level + 1)

        def label(w: float) -> Column:
            return F.concat_ws(":", *[F.floor(F.col(x) / w).cast("string") for x in self.xs])

        parent = F.lit("") if level == 0 else label(width)
        family = core.select("node", parent.alias("box"), label(finer).alias("child")).distinct()
        for side in ("a", "b"):
            named = family.select(F.col("node").alias(f"{side}_node"), F.col("box").alias(f"{side}_box"),
                                  F.col("child").alias(f"{side}_child"))
            pairs = pairs.join(named, [f"{side}_node", f"{side}_box"]).drop(f"{side}_box").withColumnRenamed(
                f"{side}_child", f"{side}_box")
        return pairs.select("a_node", "a_box", "b_node", "b_box")


def neighbour_counts(points: DataFrame, columns: Sequence[str], eps: float, min_pts: int = 5,
                     key: str = "meter_id") -> DataFrame:
    """Whether each point is core, that is has min_pts points within eps, itself included: key, core."""
    named = points.select(key, *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)])
    grid = _Grid(named, columns, eps, min_pts)
    return sized_join(named, grid.core_flags().select(*grid.xs, "core"), grid.xs, key, grid.copies).select(key, "core")


def cluster_dbscan(points: DataFrame, columns: Sequence[str], eps: float, min_pts: int = 5,
                   key: str = "meter_id") -> DataFrame:
    """Density clusters: key, core, clust_id; noise has -1.

    Clusters are numbered by their smallest core key; a border point takes the smallest cluster it touches.
    """
    named = points.select(key, *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(columns)])
    grid = _Grid(named, columns, eps, min_pts)
    flags = grid.core_flags().withColumn("node", grid.node())
    core = flags.where("core").select(*grid.xs, *grid.cs, "node")
    roots = components(core.select("node").distinct(), grid.edges(core))
    # numbers are settled per cell, so no join or group runs over all points of a cluster
    own = sized_join(named, core.select(*grid.xs, "node"), grid.xs, key, grid.copies)
    lowest = own.groupBy("node").agg(F.min(key).alias("_first"))
    cells = cut_lineage(roots.join(lowest, "node"))
    firsts = cells.groupBy("root").agg(F.min("_first").alias("_first"))
    if dict(firsts.dtypes)["_first"] in ("int", "bigint", "smallint", "tinyint"):
        numbered = positions(firsts, [], ["_first"], number_block("_first"), "clust_id")
    else:
        numbered = firsts.withColumn("clust_id", F.row_number().over(W.orderBy("_first")) - 1)
    numbers = sized_join(cells.select("node", "root"), numbered.select("root", "clust_id"), "root", "node", cells.count())
    numbers = numbers.select("node", "clust_id")
    cores = cut_lineage(sized_join(core, numbers, "node", grid.xs, grid.largest).select(*grid.xs, *grid.cs, "clust_id"))
    touched = grid.neighbours(flags.where("not core"), cores).groupBy(*grid.qs).agg(F.min("clust_id").alias("clust_id"))
    borders = touched.withColumnsRenamed(dict(zip(grid.qs, grid.xs)))
    labels = cores.select(*grid.xs, "clust_id").unionByName(borders)
    spots = flags.select(*grid.xs, "core").join(labels, grid.xs, "left")
    spots = spots.withColumn("clust_id", F.coalesce(F.col("clust_id"), F.lit(NOISE)).cast("int"))
    return sized_join(named, spots, grid.xs, key, grid.copies).select(key, "core", "clust_id")
