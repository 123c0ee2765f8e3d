"""Least squares on the value of every meter at the base, for any number of meters and of bases.

The weights of all horizons are found together by block conjugate gradients. The feature matrix of a cluster is cut along
its longer side: a packed row holds some lines, a line being one meter at all training bases or one base at all meters. A
step takes each packed block M to M'(M v), where v is what the solver asks for, and adds the results up; no line ever
meets another one. What a step keeps of a cluster is as long as the shorter side, its bases or its meters; without ridge
always its meters, because the solution of least norm is reached there only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators.conjugate import Descent
from wattloom.session import cut_lineage

#: Bytes of a packed block, about.
BLOCK = 1 << 21
#: Numbers of a table that is sent whole to every task, at most (8 MB); a larger one is joined by key.
SENT = 1 << 20
#: Random columns beside the targets.
BESIDE = 72
#: Length of what is left of the equations, as a share of their right-hand side, at which a fit ends.
TOLERANCE = 1e-11


def feature_table(series: DataFrame, clusters: DataFrame, samples: DataFrame, key: str, value: str) -> DataFrame:
    """clust_id, col, base_pos, x and times (how often the base is drawn for training) of every feature at every base.

    Columns are the meters of the cluster and the time variables in ``features``. A meter without values is no feature.
    """
    bases = cut_lineage(samples.groupBy("clust_id", "base_pos").agg(F.count_if(F.col("role") == "train").alias("times"), F.first("features").alias("features")))
    known = series.where(F.col(value).isNotNull()).select(F.col("pos").alias("base_pos"), key, F.col(value).cast("double").alias("x"))
    meters = known.join(clusters.select(key, "clust_id"), key).join(bases.select("clust_id", "base_pos", "times"), ["clust_id", "base_pos"])
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    variables = bases.select("clust_id", "base_pos", "times", F.posexplode("features").alias("at", "x"))
    return cut_lineage(meters.select("clust_id", name("m", F.col(key)).alias("col"), "base_pos", "x", "times").unionByName(
        variables.select("clust_id", name("t", F.col("at")).alias("col"), "base_pos", "x", "times")))


def _array_sum(column: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(column)))


def _sides(train: DataFrame, aims: DataFrame, short: str) -> DataFrame:
    """A row per cluster for its shorter side: ids in order, the number drawn of each base and the mean of each column."""
    if short == "base_pos":
        ends = aims.groupBy("clust_id").agg(F.sort_array(F.collect_list(F.struct("base_pos", "times"))).alias("e"))
        return ends.select("clust_id", F.col("e.base_pos").alias("ids"), F.col("e.times").cast("array<double>").alias("times"), F.lit(None).cast("array<double>").alias("means"))
    means = train.groupBy("clust_id", "col").agg((F.sum(F.col("x") * F.col("times")) / F.sum("times")).alias("mean"))
    ends = means.groupBy("clust_id").agg(F.sort_array(F.collect_list(F.struct("col", "mean"))).alias("e"))
    return ends.select("clust_id", F.col("e.col").alias("ids"), F.lit(None).cast("array<double>").alias("times"), F.col("e.mean").alias("means"))


def _sent(df: DataFrame, numbers: int) -> DataFrame:
    return F.broadcast(df) if numbers <= SENT else df


def _blocks(train: DataFrame, sides: DataFrame, short: str, numbers: int) -> DataFrame:
    """clust_id, block, lines and means (of its lines) and matrix (lines x ids), centred, each base times the root of its
    number. A missing value counts as the mean."""
    long = "col" if short == "base_pos" else "base_pos"
    lines = train.groupBy("clust_id", long).agg(F.collect_list(F.struct(F.col(short).alias("id"), "x")).alias("held"), F.first("times").alias("n"))
    joined = lines.join(_sent(sides, numbers), "clust_id").select("clust_id", F.col(long).cast("string").alias("line"), F.col("held.id").alias("at"), F.col("held.x").alias("x"), "n", "ids", "times", "means")

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, names, means, rows = None, [], [], []

        def closed() -> Iterator[pd.DataFrame]:
            if rows:
                yield pd.DataFrame([(block, names, means, np.stack(rows).tobytes())], columns=["clust_id", "lines", "means", "matrix"])

        for part in parts:
            for r in part.itertuples(index=False):
                if rows and (block != r.clust_id or len(rows) * rows[0].nbytes >= BLOCK):
                    yield from closed()
                    names, means, rows = [], [], []
                line = np.full(len(r.ids), np.nan)
                line[pd.Index(r.ids).get_indexer(r.at)] = r.x
                if short == "base_pos":
                    mean = float(np.nansum(line * r.times) / r.times[~np.isnan(line)].sum())
                    line = np.where(np.isnan(line), 0.0, line - mean) * np.sqrt(r.times)
                else:
                    mean, line = 0.0, np.where(np.isnan(line), 0.0, line - r.means) * np.sqrt(r.n)
                block = r.clust_id
                names.append(r.line)
                means.append(mean)
                rows.append(line)
        yield from closed()

    kind = train.schema["clust_id"].dataType.simpleString()
    dealt = joined.sortWithinPartitions("clust_id")
    packed = dealt.mapInPandas(pack, f"clust_id {kind}, lines array<string>, means array<double>, matrix binary")
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


def _multiplied(blocks: DataFrame, vectors: DataFrame, numbers: int) -> DataFrame:
    """clust_id, at and v: M'(M v) for the columns v of each cluster, added up within tasks and then over all blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cluster, total = None, None

        def closed() -> Iterator[pd.DataFrame]:
            if total is not None:
                yield pd.DataFrame({"clust_id": cluster, "at": np.arange(len(total)), "v": list(total)})

        for part in parts:
            for r in part.itertuples(index=False):
                if total is not None and cluster != r.clust_id:
                    yield from closed()
                    total = None
                v = np.frombuffer(r.ask).reshape(r.size, -1)
                matrix = np.frombuffer(r.matrix).reshape(-1, r.size)
                cluster, total = r.clust_id, matrix.T @ (matrix @ v) + (0 if total is None else total)
        yield from closed()

    kind = blocks.schema["clust_id"].dataType.simpleString()
    joined = blocks.select("clust_id", "matrix").join(_sent(vectors, numbers), "clust_id").sortWithinPartitions("clust_id")
    return joined.mapInPandas(run, f"clust_id {kind}, at int, v array<double>").groupBy("clust_id", "at").agg(_array_sum(F.col("v")).alias("v"))


def _asked(states: DataFrame, found: bool = False) -> DataFrame:
    """clust_id, ask and size: the columns to multiply, or those found."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            solvers = [Descent.unpacked(b) for b in part["solver"]]
            asked = [s.found if found else s.ask for s in solvers]
            yield pd.DataFrame({"clust_id": part["clust_id"], "ask": [np.ascontiguousarray(a).tobytes() for a in asked], "size": [len(a) for a in asked]})

    return states.mapInPandas(unpack, f"clust_id {states.schema['clust_id'].dataType.simpleString()}, ask binary, size int")


def _started(goals: DataFrame, sides: DataFrame, width: int, ridge: float) -> DataFrame:
    """clust_id, solver and done. ``goals``: clust_id, at (place on the shorter side) and v, targets first."""

    def start(side: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        goal = np.zeros((len(side["ids"].iloc[0]), width + BESIDE))
        if len(rows):
            goal[rows["at"]] = np.stack(rows["v"])
        solver = Descent.of(goal[:, :width], ridge, TOLERANCE, goal[:, width:])
        return pd.DataFrame([(side["clust_id"].iloc[0], solver.packed(), solver.done)], columns=["clust_id", "solver", "done"])

    kind = goals.schema["clust_id"].dataType.simpleString()
    own = sides.select(F.col("clust_id").alias("clust_id"), "ids")  # a column of its own: both sides may come from the same bases
    return own.groupBy("clust_id").cogroup(goals.groupBy("clust_id")).applyInPandas(start, f"clust_id {kind}, solver binary, done boolean")


def _step(state: pd.DataFrame, product: pd.DataFrame) -> pd.DataFrame:
    solver = Descent.unpacked(state["solver"].iloc[0])
    found = np.zeros(solver.ask.shape)
    if len(product):
        found[product["at"]] = np.stack(product["v"])
    solver.step(found, TOLERANCE)
    return state.assign(solver=[solver.packed()], done=solver.done)


def _beside(by: Sequence[str]) -> Column:
    """Fixed random columns of a row: numbers between -1 and 1 from hashes of its key."""
    return F.transform(F.sequence(F.lit(1), F.lit(BESIDE)), lambda k: F.xxhash64(*by, k) / F.lit(2.0**63))


def _aims(samples: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Training bases with the number drawn and v, centred targets and random columns times the root of that number; and the
    mean target of each cluster."""
    drawn = cut_lineage(samples.where("role = 'train'").groupBy("clust_id", "base_pos").agg(F.count("*").alias("times"), F.first("targets").alias("y")))
    mean = drawn.groupBy("clust_id").agg(_array_sum(F.transform("y", lambda y: y * F.col("times"))).alias("total"), F.sum("times").alias("n"))
    mean = cut_lineage(mean.select("clust_id", F.transform("total", lambda t: t / F.col("n")).alias("mean")))
    columns = F.concat(F.zip_with("y", "mean", lambda y, m: y - m), _beside(["clust_id", "base_pos"]))
    return drawn.join(mean, "clust_id").select("clust_id", "base_pos", "times", F.transform(columns, lambda v: v * F.sqrt("times")).alias("v")), mean


def _goals(sides: DataFrame, blocks: DataFrame, aims: DataFrame, short: str) -> DataFrame:
    """Right-hand side on the shorter side: the targets themselves, or the transposed features times them."""
    if short == "base_pos":
        places = sides.select("clust_id", F.posexplode("ids").alias("at", "base_pos"))
        return aims.join(places, ["clust_id", "base_pos"]).select("clust_id", "at", "v")
    lines = blocks.select("clust_id", F.posexplode("lines").alias("k", "base_pos"), "block")
    wanted = lines.withColumn("base_pos", F.col("base_pos").cast("long")).join(aims.select("clust_id", "base_pos", "v"), ["clust_id", "base_pos"])
    listed = wanted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("y")).select("block", F.col("y.v").alias("y"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                y = np.stack(r.y)
                total = np.frombuffer(r.matrix).reshape(len(y), -1).T @ y
                yield pd.DataFrame({"clust_id": r.clust_id, "at": np.arange(len(total)), "v": list(total)})

    kind = blocks.schema["clust_id"].dataType.simpleString()
    each = blocks.select("clust_id", "matrix", "block").join(listed, "block")
    return each.mapInPandas(run, f"clust_id {kind}, at int, v array<double>").groupBy("clust_id", "at").agg(_array_sum(F.col("v")).alias("v"))


def _weights(states: DataFrame, sides: DataFrame, blocks: DataFrame, short: str, numbers: int) -> DataFrame:
    """clust_id, col, mean and w (a weight per horizon)."""
    found, kind = _asked(states, found=True), states.schema["clust_id"].dataType.simpleString()
    schema = f"clust_id {kind}, col string, mean double, w array<double>"
    if short == "base_pos":
        rows = blocks.join(_sent(found, numbers), "clust_id").select("clust_id", "lines", "means", "matrix", "ask", "size")
    else:
        rows = sides.join(found, "clust_id").select("clust_id", F.col("ids").alias("lines"), "means", F.lit(None).cast("binary").alias("matrix"), "ask", "size")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                w = np.frombuffer(r.ask).reshape(r.size, -1)
                w = w if r.matrix is None else np.frombuffer(r.matrix).reshape(-1, r.size) @ w
                yield pd.DataFrame({"clust_id": r.clust_id, "col": r.lines, "mean": r.means, "w": list(w)})

    return cut_lineage(rows.mapInPandas(run, schema))


def forecast_meters(series: DataFrame, clusters: DataFrame, samples: DataFrame, ridge: float = 0.0,
                    key: str = "meter_id", value: str = "value", rounds: int = 2000) -> DataFrame:
    """Linear forecasts per cluster from each meter's value at the base and the time variables.

    ``samples`` has clust_id, base_pos, role, features (time variables only) and targets; a base drawn twice counts twice.
    Without ridge the fit is the minimum-norm least-squares one. All clusters and horizons are fitted together, a job per
    step; the driver sees whether clusters are left. Fails if some are after ``rounds`` steps.
    """
    width = samples.select(F.max(F.size("targets"))).first()[0]
    if width is None:
        raise ValueError("no samples")
    table = feature_table(series, clusters, samples, key, value)
    train = table.where("times > 0")
    aims, mean = _aims(samples, width)
    bases, cols = [train.select("clust_id", c).distinct().groupBy("clust_id").count().agg(F.max("count"), F.sum("count")).first() for c in ("base_pos", "col")]
    short = "base_pos" if ridge > 0 and (bases[0] or 0) <= (cols[0] or 0) else "col"
    numbers = ((bases if short == "base_pos" else cols)[1] or 0) * (width + BESIDE)
    sides = cut_lineage(_sides(train, aims, short))
    blocks = _blocks(train, sides, short, numbers)
    states = cut_lineage(_started(_goals(sides, blocks, aims, short), sides, width, ridge))
    for _ in range(rounds):
        left = states.where("NOT done")
        if left.isEmpty():
            break
        stepped = left.groupBy("clust_id").cogroup(_multiplied(blocks, _asked(left), numbers).groupBy("clust_id")).applyInPandas(_step, states.schema)
        states = cut_lineage(stepped.unionByName(states.where("done")))
    else:
        raise RuntimeError(f"not all clusters are fitted after {rounds} steps; more ridge makes the fit easier")
    weights = _weights(states, sides, blocks, short, numbers)
    scaled = lambda c: F.transform("w", lambda w: w * F.col(c))
    offset = weights.groupBy("clust_id").agg(_array_sum(scaled("mean")).alias("off")).join(mean, "clust_id")
    asked = samples.where("role = 'test'").select("clust_id", "base_pos")
    at = table.join(asked.distinct(), ["clust_id", "base_pos"], "left_semi").join(_sent(weights, cols[1] * width), ["clust_id", "col"])
    made = at.groupBy("clust_id", "base_pos").agg(_array_sum(scaled("x")).alias("p")).join(offset, "clust_id")
    values = F.transform("p", lambda p, h: p + F.get("mean", h) - F.get("off", h))
    flat = asked.join(made, ["clust_id", "base_pos"]).select("clust_id", "base_pos", F.posexplode(values).alias("at", "pred_val"))
    return flat.select("clust_id", "base_pos", (F.col("at") + 1).cast("int").alias("horizon"), (F.col("base_pos") + F.col("at") + 1).alias("pos"), "pred_val")
