"""URL parts, fixed rules and mined rules against brute force."""

import itertools
import random
import re

from pyspark.sql import functions as F

from wattloom.llm.url_rules import FIXED, host_of, judge, match, mine, path_of, tokens

URLS = ["http://A.B.com", "HTTP://a.ORG/C?x://y", "http://a.org?x=1#t", "abc", "", "x://?q", "://h/p#a?b", None, "http://h#a/b?c", "https://example.org/es/1", "https://x.example.org/en/12",
        "https://myexample.org/es/", "http://fr.com/fr/9/", "http://a.com/de/", "http://a.com/de", "http://Ä.com/x", "http://example.org", "a://b://c/d"]


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(d + s), v, d + s) for v, d, s in FIXED if (host == d or host.endswith("." + d)) and path.startswith(s)]
    return max(fits)[1:] if fits else None


def test_parts_and_fixed_rules(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id int, url string, host string")
    labels = spark.createDataFrame([], "doc_id bigint, rejected boolean")
    out = {r["page_id"]: r for r in judge(pages, labels).collect()}
    assert len(out) == len(URLS)
    for k, url in enumerate(URLS):
        host, path = brute(url)
        rule = brute_rule(host, path)
        assert (out[k]["host"], out[k]["path"]) == (host, path)
        assert (out[k]["verdict"], out[k]["rule"]) == (rule or ("allow", None))


def _labelled(rng, count):
    sets = []
    for _ in range(count):
        s = {rng.choice("abc"), rng.choice("def"), rng.choice("ghi")}
        bad = rng.random() < (0.9 if {"a", "d"} <= s else 0.8 if "i" in s else 0.1)
        sets.append((sorted(s), bad))
    return sets


def brute_rules(sets, support, confidence, least):
    found = {}
    names = sorted({t for s, _ in sets for t in s})
    for size in (1, 2, 3):
        for items in itertools.combinations(names, size):
            have = [bad for s, bad in sets if set(items) <= set(s)]
            if sum(have) >= max(support * len(sets), least) and sum(have) / len(have) >= confidence:
                found[items] = sum(have) / len(have)
    return {i: c for i, c in found.items() if not any(set(j) < set(i) and found[j] >= c for j in found)}


def test_mined_rules_and_matches(spark):
    sets = _labelled(random.Random(0), 400)
    df = spark.createDataFrame(sets, "tokens array<string>, rejected boolean").repartition(3)
    rules = mine(df, 0.02, 0.5, 10)
    wanted = brute_rules(sets, 0.02, 0.5, 10)
    found = {tuple(r["tokens"]): r["confidence"] for r in rules.collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted) and wanted
    urls = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(sets)] + [(900, []), (901, ["zz"])], "id long, tokens array<string>")
    fired = {r["id"]: r["n_rules"] for r in match(urls, rules).collect()}
    assert fired == {k: n for k, (s, _) in enumerate(sets) if (n := sum(set(i) <= set(s) for i in wanted))}


def test_mined_rules_block(spark):
    pages = [(k, f"https://{'ads' if k % 4 == 0 else 'good'}.site.net/en/{k}?page={k}") for k in range(200)] + [(None, "https://ads.site.net/new"), (7, None), (7, "https://good.site.net/x")]
    labels = [(k, k % 4 == 0) for k in range(200)] + [(0, None), (None, True), (2, False)]
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    out = judge(df, spark.createDataFrame(labels, "doc_id bigint, rejected boolean")).collect()
    assert len(out) == len(pages)
    assert all((r["verdict"] == "block") == r["host"].startswith("ads.") for r in out)
    assert judge(df.where("false"), spark.createDataFrame(labels, "doc_id bigint, rejected boolean")).count() == 0


def test_tokens(spark):
    row = spark.createDataFrame([("https://M.x.org/en/a12/?q=1&q=2&r#f",)], "u string").select(tokens(F.col("u")).alias("t"), host_of(F.col("u")), path_of(F.col("u"))).first()
    assert sorted(row["t"]) == sorted(["host:m.x.org", "host:x.org", "host:org", "path:en", "path:a#", "query:q", "query:r", "scheme:https", "fragment"])


def test_only_jvm_operations(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.expr("quality = 0").alias("rejected"))
    plan = judge(spark.read.parquet(f"{sf}/pages.parquet"), labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
