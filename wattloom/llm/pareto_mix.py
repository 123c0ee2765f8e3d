"""Mixing sources to target weights by Pareto order sampling, in DataFrame and SQL operations only.

A source's target may ask for more than its words. Every document first gets the whole copies that are certain; the
rest is a sample without replacement: documents are ranked by the odds of a random number divided by the odds of their
inclusion, and the first ones are taken until their words make up the rest of the target. The sample size is fixed in
words, to within half of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import small_side, word_count
from wattloom.session import cut_lineage

#: Steps per doubling of the rank: only the documents of one step per source are sorted.
STEPS = 4096


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size) with target and whether it is at its cap.

    Sources in code point order, null last, take the weights in turn. All of them share ``share`` times the sum of sizes
    by weight, none more than ``cap`` times its own size; what is above goes to the others by weight until none is above.
    The table has one row per source, not per document.
    """
    spark = sources.sparkSession
    weight = "CASE " + " ".join(f"WHEN (place - 1) % {len(weights)} = {k} THEN {w}" for k, w in enumerate(weights)) + " END"
    return spark.sql(f"""
        WITH placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM {{sources}}),
        weighed AS (SELECT *, cast({weight} AS double) AS weight FROM placed),
        lined AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, place) AS line FROM weighed),
        filled AS (SELECT *, ({share}D * sum(source_size) OVER () - {cap}D * (sum(source_size) OVER (ORDER BY line) - source_size))
            / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY line) - weight)) AS level FROM lined),
        flagged AS (SELECT *, level * weight > {cap}D * source_size AS full FROM filled)
        SELECT source, source_size, full OR source_size = 0 AS full,
            CASE WHEN full OR source_size = 0 THEN {cap}D * source_size ELSE weight * (min(CASE WHEN NOT full THEN struct(line, level) END) OVER ()).level END AS target
        FROM flagged""", sources=sources)


def _classes(units: DataFrame, aims: DataFrame, cap: float) -> DataFrame:
    """Copies that each size class of a source should get on average; longer documents have larger inclusion odds."""
    return units.sparkSession.sql(f"""
        WITH sums AS (SELECT source, class, sum(size * n) AS words FROM {{units}} WHERE size > 0 GROUP BY source, class),
        lined AS (SELECT s.source, s.class, s.words, a.source_size, a.target, a.full,
            (a.target - {cap}D * ((sum(words) OVER up) - words)) / ((sum(words * class) OVER (PARTITION BY s.source)) - ((sum(words * class) OVER up) - words * class)) AS level
            FROM sums s JOIN {{aims}} a ON s.source <=> a.source WINDOW up AS (PARTITION BY s.source ORDER BY s.class DESC)),
        flagged AS (SELECT *, full OR level * class > {cap}D AS top FROM lined),
        meant AS (SELECT *, CASE WHEN top THEN {cap}D ELSE class * (max(CASE WHEN NOT top THEN struct(class, level) END) OVER (PARTITION BY source)).level END AS copies FROM flagged)
        SELECT source, class, source_size, target, copies, floor(copies) AS whole, copies - floor(copies) AS part,
            target - sum(floor(copies) * words) OVER (PARTITION BY source) AS rest FROM meant""", units=units, aims=aims)


def _rank(seed: int, key: str) -> str:
    random = f"(cast(conv(substr(md5(concat('{seed}:', coalesce(cast({key} AS string), ''))), 1, 13), 16, 10) AS bigint) + 0.5D) / 4503599627370496D"
    return f"CASE WHEN part > 0 THEN {random} * (1 - part) / ((1 - {random}) * part) END"


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 4) -> DataFrame:
    """All columns of ``docs`` and size, source_size, target, copies, taken.

    size: words of the text (null: 0). copies: how often the mix takes the document, from 0 to ``cap``; taken: copies
    times size. The random number is a hash of the key, so reruns agree. A null source is a source. Documents without
    words, and null texts, are never taken. Rows that agree in key, source and size are one unit: they are taken
    together, whatever their number, and their words count as often as they occur. Columns of ``docs`` with the names
    of the new ones, in any case, are replaced; all others may have any name. An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    units = cut_lineage(named.groupBy("source", "key", "size").agg(F.count("*").alias("n")).withColumn("class", F.length(F.bin("size"))))
    aims = cut_lineage(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap))
    classes = cut_lineage(_classes(units, aims, cap))
    odds = f"""SELECT u.*, {_rank(seed, "u.key")} AS rank, c.rest FROM {{units}} u JOIN {{classes}} c ON u.source <=> c.source AND u.class = c.class WHERE u.size > 0 AND c.part > 0"""
    ranked = spark.sql(f"SELECT *, floor(log2(rank) * {STEPS}) AS step FROM ({odds})", units=units, classes=small_side(classes))
    cuts = spark.sql("""
        WITH steps AS (SELECT source, step, first(rest) AS rest, sum(size * n) AS words FROM {ranked} GROUP BY source, step),
        summed AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY step) AS upto FROM steps),
        edges AS (SELECT source, first(rest) AS rest, max(upto) FILTER (WHERE upto <= rest) AS before, max(step) FILTER (WHERE upto <= rest) AS below,
            min(step) FILTER (WHERE upto > rest) AS step FROM summed GROUP BY source),
        near AS (SELECT r.source, r.rank, r.key, r.size, r.n, e.rest, coalesce(e.before, 0) + sum(r.size * r.n) OVER (PARTITION BY r.source ORDER BY r.rank, r.key, r.size) AS upto
            FROM {ranked} r JOIN edges e ON r.source <=> e.source AND r.step = e.step)
        SELECT e.source, e.below, max(struct(rank, key, size)) AS last FROM edges e
        LEFT JOIN (SELECT * FROM near WHERE upto - size * n / 2.0D <= rest) n ON e.source <=> n.source GROUP BY e.source, e.below""", ranked=ranked)
    cuts = cut_lineage(cuts)
    new = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in new]
    row = docs.select(F.struct(*kept).alias("_row"), word_count(F.col(text)).alias("size"), F.struct(F.col(key).alias("key"), F.col(source).alias("source"), F.length(F.bin(word_count(F.col(text)))).alias("class")).alias("_u"))
    row = row.join(small_side(aims.select(F.col("source").alias("_s"), "source_size", "target")), F.col("_u.source").eqNullSafe(F.col("_s"))).drop("_s")
    row = row.join(small_side(classes.select(F.col("source").alias("_s"), F.col("class").alias("_c"), "whole", "part")), F.col("_u.source").eqNullSafe(F.col("_s")) & (F.col("_u.class") == F.col("_c")), "left").drop("_s", "_c")
    row = row.join(small_side(cuts.select(F.col("source").alias("_s"), "below", "last")), F.col("_u.source").eqNullSafe(F.col("_s")), "left").drop("_s")
    row = row.withColumn("_r", F.expr(_rank(seed, "_u.key")))
    drawn = F.expr(f"_r IS NOT NULL AND (floor(log2(_r) * {STEPS}) <= below OR struct(_r, _u.key, size) <= last)")
    row = row.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.when(drawn, 1).otherwise(0)).cast("int"))
    return row.select(*[F.col("_row")[c].alias(c) for c in kept], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
