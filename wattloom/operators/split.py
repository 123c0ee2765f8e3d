"""Season, base positions, train and test periods over the index of a series.

The index has one row per grid time (``pos``, ``time``), whatever the number of meters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.conf import ForecastConf
from wattloom.operators.ordered import number_block, positions
from wattloom.session import cut_lineage


def in_season(time: Column, months: Sequence[int], season: str) -> Column:
    summer = F.month(time).isin(*months)
    return summer if season == "summer" else ~summer


def season_index(index: DataFrame, conf: ForecastConf) -> DataFrame:
    return index.where(in_season(F.col(conf.time_flag_var), conf.summer_months, conf.season))


def shifted(index: DataFrame, by: int) -> DataFrame:
    return index.select((F.col("pos") + by).alias("pos"))


def season_gaps(season: DataFrame) -> DataFrame:
    """Jumps in the season positions: first position after each jump and the size of the jump.

    Segment starts and ends come from anti joins; only these few rows, two per segment, are ordered.
    """
    starts = season.select("pos").join(shifted(season, 1), "pos", "left_anti")
    ends = season.select("pos").join(shifted(season, -1), "pos", "left_anti")
    edges = starts.withColumn("start", F.lit(1)).unionByName(ends.withColumn("start", F.lit(0)))
    before = F.lag("pos").over(W.orderBy("pos", F.col("start").desc()))
    jumps = edges.withColumn("gap", F.col("pos") - before)
    return jumps.where((F.col("start") == 1) & (F.col("gap") > 1)).select("pos", "gap")


def check_season(season: DataFrame, conf: ForecastConf) -> None:
    """Fail when a window could reach across the gap between two segments; one segment is valid."""
    smallest = season_gaps(season).agg(F.min("gap")).first()[0]
    if smallest is None:
        return
    for name, length in (("prev_times", conf.prev_times), ("next_times", conf.next_times)):
        if length >= smallest:
            raise ValueError(f"{name} {length} is not smaller than the season gap {smallest}")


def base_positions(season: DataFrame, prev_times: int, next_times: int) -> DataFrame:
    """Season positions whose window start and last target also lie in the season."""
    started = season.join(shifted(season, prev_times), "pos", "left_semi")
    return started.join(shifted(season, -next_times), "pos", "left_semi")


def intersect_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("pos"), "pos", "left_semi")


def except_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("pos"), "pos", "left_anti")


def ranked(bases: DataFrame) -> DataFrame:
    """Bases with their 0-based rank ``_rank``, scanned in blocks of positions."""
    return positions(bases, [], ["pos"], number_block("pos"), "_rank")


def split_point(bases: DataFrame, conf: ForecastConf) -> DataFrame:
    """One row ``test_start``: the first midnight base whose quantile rank/(n-1) exceeds 1 - test_ratio."""
    return ranked_split_point(ranked(bases), conf)


def ranked_split_point(bases: DataFrame, conf: ForecastConf) -> DataFrame:
    last = bases.agg(F.max("_rank").alias("last")).scalar()
    quantile = F.try_divide(F.col("_rank").cast("double"), last.cast("double"))
    at = F.col(conf.time_flag_var)
    late = (quantile > 1 - conf.test_ratio) & (F.hour(at) == 0) & (F.minute(at) == 0)
    return bases.where(late).agg(F.min("pos").alias("test_start"))


def period_roles(season: DataFrame, test_start: Column) -> DataFrame:
    """Season positions marked ``train`` before the split and ``test`` from it on."""
    return season.withColumn("role", F.when(F.col("pos") < test_start, "train").otherwise("test"))


def every_nth(bases: DataFrame, n: int) -> DataFrame:
    return ranked(bases).where(F.col("_rank") % n == 0).drop("_rank")


def train_bases(bases: DataFrame, test_start: Column, next_times: int = 0, purge: bool = False) -> DataFrame:
    """Bases before the split; ``purge`` drops those whose targets reach into the test period."""
    reach = next_times if purge else 0
    return bases.where(F.col("pos") + reach < test_start)


def test_bases(bases: DataFrame, test_start: Column, next_times: int) -> DataFrame:
    """Every next_times-th base, from the one before the split on, so test windows do not overlap."""
    return every_nth(bases.where(F.col("pos") >= test_start - 1), next_times)


def bootstrap_bases(train: DataFrame, n_bases: int, ratio: float, seed: int = 0) -> DataFrame:
    """int(n_bases * ratio) training bases drawn with replacement, in position order.

    Draw i takes the training base whose rank is a hash of i and the seed, so a repeated task draws the same.
    """
    if ratio >= 1:
        return train.orderBy("pos")
    count = train.agg(F.count("*").alias("n")).scalar()
    draws = train.sparkSession.range(int(n_bases * ratio)).select(
        F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit(seed))), 1, 15), 16, 10).cast("long"), count).alias("_rank"))
    return draws.join(ranked(train), "_rank").drop("_rank").orderBy("pos")


class Split:
    """Index sets of one configuration.

    The ranked bases are computed once and written; everything else is a filter on them or on the season. Fails when a
    window could reach across the gap between two segments of the season. ``seed`` is that of the training sample.
    """

    def __init__(self, index: DataFrame, conf: ForecastConf, purge: bool = False, seed: int = 0):
        self.conf, self.seed = conf, seed
        self.season = season_index(index, conf)
        check_season(self.season, conf)
        ranks = cut_lineage(ranked(base_positions(self.season, conf.prev_times, conf.next_times)))
        self.bases = ranks.drop("_rank")
        self.start = ranked_split_point(ranks, conf)
        start = self.start.scalar()
        self.roles = period_roles(self.season, start)
        self.train = train_bases(self.bases, start, conf.next_times, purge)
        late = ranks.where(F.col("pos") >= start - 1)
        first = late.agg(F.min("_rank").alias("r")).scalar()
        self.test = late.where((F.col("_rank") - first) % conf.next_times == 0).drop("_rank")

    def training_sample(self) -> DataFrame:
        if self.conf.train_sample_ratio >= 1:
            return self.train
        return bootstrap_bases(self.train, self.bases.count(), self.conf.train_sample_ratio, self.seed)

    def base_roles(self) -> DataFrame:
        """Training and test bases in one table with a ``role`` column; a base can have both roles."""
        train = self.training_sample().withColumn("role", F.lit("train"))
        return train.unionByName(self.test.withColumn("role", F.lit("test")))
