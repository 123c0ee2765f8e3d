"""URL filters by association rules, in DataFrame, SQL and Spark ML operations only.

Labelled URLs are sets of tokens; FP-growth finds the sets that are frequent among them, and the rules "tokens imply
rejected" that are confident enough are kept, unless a shorter rule of at least the same confidence says the same. A URL
is rejected if all tokens of some rule occur in it. Rules are looked up by their rarest token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import small_side
from wattloom.session import cut_lineage

REJECTED = "label:rejected"
#: Host and path rules that come before any mined rule: verdict, host, start of the path.
FIXED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    rest = F.substring_index(F.substring_index(F.substring_index(after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(url.isNull() | (at == 0), "").otherwise(F.substr(url, at + 3))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = after_scheme(url)
    return F.substring_index(F.substring_index(F.substr(rest, F.length(host_of(url)) + 1), "?", 1), "#", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, every suffix of the host, path segments, names of query parameters, fragment.

    Runs of digits in path segments are one sign, as numbers of single pages say nothing about others.
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"[0-9]+", "#")))
    query = F.substring_index(F.when(F.locate("?", url) > 0, F.substr(url, F.locate("?", url) + 1)).otherwise(""), "#", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    more = F.array_compact(F.array(F.when(F.locate("://", url) > 0, F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))), F.when(F.locate("#", url) > 0, F.lit("fragment"))))
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, segments, names, more)))


def mine(labelled: DataFrame, least_support: float = 0.002, least_confidence: float = 0.5, least_urls: int = 10) -> DataFrame:
    """Rules (rule_id, tokens, key, confidence, support) from ``labelled`` (tokens, rejected boolean).

    A rule's support is the share of labelled URLs that it finds and that are rejected: at least ``least_support``, and
    at least ``least_urls`` URLs. ``key`` is the token of the rule that the fewest labelled URLs have. Each labelled URL
    is one transaction. No labelled URL, or none that is rejected, gives no rule.
    """
    items = cut_lineage(labelled.select(F.when(F.col("rejected"), F.concat("tokens", F.array(F.lit(REJECTED)))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0))
    urls = items.count()
    if urls < least_urls:
        return items.where("false").selectExpr("0L AS rule_id", "items AS tokens", "'' AS key", "0D AS confidence", "0D AS support")
    model = FPGrowth(itemsCol="items", minSupport=max(least_support, least_urls / urls), minConfidence=least_confidence).fit(items)
    found = model.associationRules.where(F.array_contains("consequent", REJECTED)).select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    found = cut_lineage(found)
    parts = found.select("tokens", "confidence", F.explode("tokens").alias("token"))
    shorter = found.select(F.col("tokens").alias("less"), F.col("confidence").alias("sure"), F.col("tokens")[0].alias("token"))
    implied = parts.join(shorter, "token").where((F.size("less") < F.size("tokens")) & (F.size(F.array_except("less", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))).select("tokens").distinct()
    pruned = found.join(implied, "tokens", "left_anti")
    counts = items.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keyed = pruned.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(counts, "token")
    rules = keyed.groupBy("tokens", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("key"))
    return cut_lineage(rules.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "key", "confidence", "support"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Id and number of rules that fire, for the rows of ``urls`` (id, tokens) in which one does.

    The inverted index has each rule once, below its rarest token. Whole token sets are looked up, each distinct set
    once, so a host with many pages costs no more than its different URLs.
    """
    index = small_side(rules.select(F.col("key").alias("token"), F.col("tokens").alias("needed")))
    sets = urls.select("tokens").distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    fired = hits.groupBy("tokens").agg(F.count("*").alias("n_rules"))
    return urls.join(fired, "tokens").select("id", "n_rules")


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = FIXED) -> Column:
    """Struct (verdict, rule) of the longest fixed rule that fits host or one of its parent domains and the start of the path; null without."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("verdict"), F.lit("").alias("rule")))
    for verdict, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        out = out.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(domain + start).alias("rule")))
    return out


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", fixed: Sequence[tuple[str, str, str]] = FIXED, least_support: float = 0.002, least_confidence: float = 0.5) -> DataFrame:
    """One row per page: key, host, path, rule (of the fixed rules, else null), n_rules mined rules that fire, verdict.

    ``labels`` has doc_id and rejected; the number that a URL's path ends in is the document it shows. A fixed rule
    decides where one fits, the longest first; elsewhere a page is blocked if a mined rule fires, and allowed otherwise.
    A null url, or one without ://, has empty host and path; it is judged by its other tokens, null by none (allow).
    Labels that are null do not count; several labels of a document reject it if one does. Repeated rows, null keys and
    equal urls stay; other columns are not read, an empty table gives no rows.
    """
    u = F.col("url")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", host_of(u).alias("host"), path_of(u).alias("path"), tokens(u).alias("tokens"))
    rows = cut_lineage(rows.withColumn("id", F.monotonically_increasing_id()))
    one = labels.where("doc_id IS NOT NULL AND rejected IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(F.bool_or("rejected").alias("rejected"))
    known = rows.select("tokens", F.expr(r"try_cast(nullif(regexp_extract(path, r'([0-9]+)[^0-9]*$', 1), '') AS bigint)").alias("doc")).join(one, "doc").select("tokens", "rejected")
    rules = mine(known, least_support, least_confidence)
    fired = match(rows.select("id", "tokens"), rules)
    chosen = fixed_rule(F.col("host"), F.col("path"), fixed)
    told = rows.join(fired, "id", "left").withColumn("_fixed", chosen).withColumn("n_rules", F.coalesce("n_rules", F.lit(0)).cast("long"))
    verdict = F.coalesce(F.col("_fixed.verdict"), F.when(F.col("n_rules") > 0, "block").otherwise("allow"))
    return told.select(F.col("key").alias(key), "host", "path", F.col("_fixed.rule").alias("rule"), "n_rules", verdict.alias("verdict"))
