"""Quality rules with robust multivariate outliers, in DataFrame and SQL operations only.

Every text gets a vector of statistics. For each language and source a minimum covariance determinant estimate is found
by concentration steps: starting from the texts nearest to the medians, mean and covariance of the current half and more
of the texts give distances, and the texts with the smallest distances are the next half. Texts whose Mahalanobis
distance to the final estimate is beyond a quantile are rejected. Copies of a text count once in an estimate. All sums
are over whole numbers, so neither the order of rows nor the partitioning changes an estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import WORD, small_side
from wattloom.session import cut_lineage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the counts of every whole text; a null text has none.

    n_repeat_words: words that lie in a window of three words which the text has twice or more. Windows are compared by
    64-bit hashes within one text.
    """
    kept = [c for c in docs.columns if c != text and c not in COUNTS]
    whole = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = whole.select(
        *kept,
        F.expr(f"regexp_extract_all(_text, r'{WORD}', 0)").alias("_words"),
        F.expr(rf"filter(split(_text, '\n'), x -> x rlike r'{WORD}')").alias("_lines"),
        F.expr(r"length(_text) - length(translate(_text, ' \t\n\u000B\u000C\r', ''))").alias("_blank"),
        F.length("_text").alias("_chars"),
        F.expr("length(_text) - length(translate(_text, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
    )
    hashed = split.select(
        *kept, "n_symbols", (F.col("_chars") - F.col("_blank")).cast("long").alias("word_chars"), F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(_words, x -> xxhash64(x))").alias("_hashes"),
    )
    windows = F.expr("""sort_array(if(n_words < 3, cast(array() AS array<struct<h: bigint, i: int>>),
        transform(sequence(0, cast(n_words AS int) - 3), i -> struct(xxhash64(_hashes[i], _hashes[i + 1], _hashes[i + 2]) AS h, i AS i))))""")
    sorted_ = hashed.select(*kept, *[c for c in COUNTS if c != "n_repeat_words"], windows.alias("_windows"))
    places = F.expr("sort_array(transform(filter(_windows, (x, j) -> get(_windows, j - 1).h = x.h OR get(_windows, j + 1).h = x.h), x -> x.i))")
    placed = sorted_.select(*kept, *[c for c in COUNTS if c != "n_repeat_words"], places.alias("_places"))
    covered = F.expr("aggregate(transform(_places, (p, j) -> least(3, coalesce(get(_places, j + 1) - p, 3))), 0, (a, x) -> a + x)")
    return placed.select(*kept, *[c for c in COUNTS if c != "n_repeat_words"], covered.cast("long").alias("n_repeat_words"))


#: Statistics, all scaled by 1000 and rounded: mean word length, symbols, repeated lines (logarithms), share of repeated
#: words (arc sine), length (logarithm); and the least standard deviation that each is given.
SCALE = 1000
STATISTICS = (
    ("ln(word_chars / n_words)", 0.05),
    ("ln(1 + 100 * n_symbols / n_words)", 0.25),
    ("ln(1 + 100 * n_dup_lines / n_words)", 1.0),
    ("asin(sqrt(n_repeat_words / n_words))", 0.15),
    ("ln(n_words)", 0.5),
)
P = len(STATISTICS)
X = [f"x{k}" for k in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Half of the mass of chi square with five degrees of freedom.
MEDIAN_CHI2 = 4.351
#: Least unit of squared distances. Where most texts are nearly the same the median distance says nothing about the others;
#: ordinary pairs have some 0.2 to 0.3.
LEAST_UNIT = 0.4
#: Share of the texts in an estimate of the highest breakdown point, and what makes the covariance of the nearest half
#: that of all under a normal law: 0.5 / P(chi square with seven degrees of freedom <= MEDIAN_CHI2).
HALF, HALF_CONSISTENCY = 0.5, 1.912
#: Distance that one text in a million exceeds under a normal law (chi square with five degrees of freedom).
CUTOFF = 5.99


def _group(lang: str, source: str, level: int) -> Column:
    """Text key of an estimation group: pair, language, or all."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("null"))
    return F.concat_ws("|", F.lit(str(level)), *([part(lang)] if level < 2 else []), *([part(source)] if level < 1 else []))


def _groups(texts: DataFrame, least: int) -> DataFrame:
    """Estimation group ``g`` of every pair (_l, _s) of language and source: pairs with fewer than ``least`` texts go together by language, languages with fewer go together."""
    sizes = cut_lineage(texts.groupBy("lang", "source").agg(F.count("*").alias("n")))
    small = F.col("n") < least
    in_lang = sizes.where(small).groupBy("lang").agg(F.sum("n").alias("m"))
    level = F.when(~small, F.lit(0)).when(F.col("m") >= least, F.lit(1)).otherwise(F.lit(2))
    named = sizes.alias("s").join(in_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left").select(F.col("s.lang").alias("_l"), F.col("s.source").alias("_s"), level.alias("level"))
    grouped = F.when(F.col("level") == 0, _group("_l", "_s", 0)).when(F.col("level") == 1, _group("_l", "_s", 1)).otherwise(_group("_l", "_s", 2))
    return cut_lineage(named.select("_l", "_s", grouped.alias("g")))


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their estimation group."""
    return rows.join(small_side(groups), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")


def _factor(moments: DataFrame, consistency: float) -> DataFrame:
    """Means and Cholesky factor (m0.., l00, l10, ..) of each group from its sums n, s0.., s00, s10, ..; the covariance is taken times ``consistency``."""
    floors = [SCALE * sd for _, sd in STATISTICS]
    out = moments.select("g", "n", *[F.expr(f"s{i} / n").alias(f"m{i}") for i in range(P)], *[F.expr(f"{consistency}D * (s{i}{j} / n - (s{i} / n) * (s{j} / n))" + (f" + {floors[i] ** 2}D" if i == j else "")).alias(f"c{i}{j}") for i, j in PAIRS])
    for j in range(P):
        for i in range(j, P):
            rest = " ".join([f"c{i}{j}", *[f"- l{i}{k} * l{j}{k}" for k in range(j)]])
            out = out.withColumn(f"l{i}{j}", F.expr(f"sqrt(greatest({rest}, 1e-9D))" if i == j else f"({rest}) / l{j}{j}"))
    return out.select("g", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance to the estimate of their group."""
    out = rows.join(small_side(estimates), "g")
    for i in range(P):
        rest = " ".join([f"x{i} - m{i}", *[f"- l{i}{k} * y{k}" for k in range(i)]])
        out = out.withColumn(f"y{i}", F.expr(f"({rest}) / l{i}{i}"))
    return out.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in range(P)))).select(*rows.columns, "d2")


def _step(d2: str = "d2") -> Column:
    """Distances in steps of a 64th of a doubling: the sorted order of distances at bounded memory."""
    return F.expr(f"cast(floor(64 * log2(greatest({d2}, 1e-6D))) AS int)")


def robust_estimates(rows: DataFrame, share: float = 0.75, steps: int = 8, consistency: float = 1.0, least_unit: float = 0.0) -> DataFrame:
    """MCD estimate of every group ``g`` of ``rows`` (whole numbers x0..): means, Cholesky factor and ``unit``.

    ``unit`` scales squared distances so that their median is that of chi square; it is ``least_unit`` at least. A
    concentration step reads the rows once: sums are taken by group and distance step, then added up from the nearest on
    until ``share`` of the texts, and of n texts (n + p + 1) / 2, are in. Up to 1 - ``share`` of a group may be outliers.
    ``consistency`` corrects the covariance of the nearest texts, which is less than that of all.
    """
    middle = rows.groupBy("g").agg(*[F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(X)])
    middle = cut_lineage(middle)
    spread = rows.join(small_side(middle), "g").groupBy("g").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i, x in enumerate(X)])
    start = [F.greatest(1.4826 * F.col(f"d{i}"), F.lit(float(SCALE * sd))) if i == j else F.lit(0.0) for i, j in PAIRS for sd in [STATISTICS[i][1]]]
    estimates = cut_lineage(spread.select("g", *[f"m{i}" for i in range(P)], *[c.alias(f"l{i}{j}") for c, (i, j) in zip(start, PAIRS, strict=True)]))
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]]
    added = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]
    needed = F.least(F.col("every"), F.greatest(F.ceil(share * F.col("every")), F.expr(f"(every + {P + 1}) div 2")))
    for _ in range(steps):
        binned = _distances(rows, estimates).groupBy("g", _step().alias("step")).agg(*sums)
        upto = binned.selectExpr("g", "step", "sum(n) OVER (PARTITION BY g) AS every", *[f"sum({c}) OVER (PARTITION BY g ORDER BY step) AS {c}" for c in added])
        half = upto.where(F.col("n") >= needed).groupBy("g").agg(*[F.min_by(c, "step").alias(c) for c in added])
        estimates = cut_lineage(_factor(half, consistency))
    binned = _distances(rows, estimates).groupBy("g", _step().alias("step")).agg(F.count("*").alias("n"))
    upto = binned.selectExpr("g", "step", "sum(n) OVER (PARTITION BY g) AS every", "sum(n) OVER (PARTITION BY g ORDER BY step) AS n")
    unit = upto.where(F.col("n") * 2 >= F.col("every")).groupBy("g").agg(F.greatest(F.pow(F.lit(2.0), (F.min("step") + 1) / 64) / MEDIAN_CHI2, F.lit(least_unit)).alias("unit"))
    return cut_lineage(estimates.join(unit, "g"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_words: int = 50, most_repeated: int = 50, least_texts: int = 50, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: key, lang, source, the counts, base_failed, distance (null if base_failed) and kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` per cent of them repeated. The others
    are kept unless their robust distance is above ``cutoff``, a far quantile of the normal law, since text statistics have
    longer tails. It has to be within reach of every statistic: those with an upper end, as the shares of repeated words
    and lines, give at most some 7 to 8 units each.
    Estimates come from the distinct texts of a language and source that pass the base rules, however often each is
    there; up to some 45 per cent of them may be junk. Null languages and sources are groups of their own; pairs with
    fewer than ``least_texts`` distinct texts are pooled. A null or empty text fails. Repeated rows and null keys stay, other
    columns are not read, an empty table gives no rows.
    """
    named = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"), F.xxhash64(text).alias("_copy"))
    counted = text_counts(named).withColumn("base_failed", F.expr(f"n_words < {least_words} OR 100 * n_repeat_words > {most_repeated} * n_words"))
    counted = cut_lineage(counted)
    passed = counted.where("NOT base_failed").select("lang", "source", "key", "_copy", *COUNTS, *[F.expr(f"cast(round({SCALE} * {s}) AS bigint)").alias(x) for x, (s, _) in zip(X, STATISTICS, strict=True)])
    texts = cut_lineage(passed.select("lang", "source", "_copy", *X).distinct())
    groups = _groups(texts, least_texts)
    estimates = robust_estimates(cut_lineage(_grouped(texts, groups).select("g", *X)), share=HALF, consistency=HALF_CONSISTENCY, least_unit=LEAST_UNIT)
    rows = _grouped(passed, groups)
    units = small_side(estimates.select("g", "unit"))
    told = _distances(rows, estimates.drop("unit")).join(units, "g").withColumn("distance", F.sqrt(F.col("d2") / F.col("unit")))
    good = told.select("key", "lang", "source", *COUNTS, F.lit(False).alias("base_failed"), "distance", (F.col("distance") <= cutoff).alias("kept"))
    bad = counted.where("base_failed").select("key", "lang", "source", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionByName(bad).withColumnRenamed("key", key)
