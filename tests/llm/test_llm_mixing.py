"""Mixing: targets, closeness to them, agreement of reruns, SQL, edge cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wattloom.llm.pareto_mix import mix, targets
from wattloom.llm.queries import ORACLES, QUERIES


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (left - sum(full.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if weight[s] * level > cap * sizes[s]]
        if not over:
            return {**full, **{s: weight[s] * level for s in rest}}
        full.update({s: cap * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 900, "ä": 50, None: 300, "Z": 7}, {"x": 10}, {"a": 0, "b": 50}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r["source"]: r["target"] for r in targets(df).collect()}
    wanted = brute_targets(sizes)
    assert found.keys() == wanted.keys() and all(found[s] == pytest.approx(wanted[s]) for s in wanted)


def test_taken_words_come_near_the_target(spark):
    rows = [(k, " ".join(["w"] * (k * 7919 % 300 + 1)), f"s{k % 5}") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    out = mix(df).collect()
    by = {}
    for r in out:
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        s = by.setdefault(r["source"], [0, r["target"], 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
    assert all(abs(taken - target) <= largest / 2 + 1e-6 for taken, target, largest in by.values())
    again = {(r["doc_id"], r["copies"]) for r in mix(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in out}


def test_longer_documents_have_larger_odds(spark):
    rows = [(k, "w " * (8 if k % 2 else 500), "a" if k < 4000 else "b") for k in range(5000)]
    out = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1, 9), share=0.6).where("source = 'a'").collect()
    mean = {n: sum(r["copies"] for r in out if r["size"] == n) / sum(1 for r in out if r["size"] == n) for n in (8, 500)}
    assert mean[500] > mean[8] > 0


def test_edge_cases(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "x y", None, 1), (None, "x y z", "a", 1), (4, "p q r", "a", 1), (4, "p q r", "a", 1), (5, "w " * 20000, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    out = mix(df).collect()
    assert len(out) == len(rows) and all(r["taken"] == 0 for r in out if r["doc_id"] in (1, 2))
    assert len({r["copies"] for r in out if r["doc_id"] == 4}) == 1
    assert {r["source_size"] for r in out if r["source"] is None} == {2}
    assert mix(df.where("false")).count() == 0


def test_columns_of_any_name(spark):
    """Columns named like the intermediate ones stay; those named like results are replaced."""
    own = ["whole", "part", "below", "last", "rest", "class", "step", "key", "n", "_u", "_r", "_s", "_c", "_row"]
    rows = [(k, "w " * (k % 90 + 1), f"s{k % 3}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    named = df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in own], F.lit(-1).alias("Copies"), F.lit(-1).alias("taken"))
    out = mix(named)
    assert out.columns == ["doc_id", "text", "source", *own, "size", "source_size", "target", "copies", "taken"]
    plain = {r["doc_id"]: r["taken"] for r in mix(df).collect()}
    for r in out.collect():
        assert r["taken"] == plain[r["doc_id"]] and all(r[c] == f"{c}{r['doc_id']}" for c in own)


def test_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    wanted = duck.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLES['op4_mixing']})").fetchall()
    assert sorted(tuple(r) for r in QUERIES["op4_mixing"](spark, sf).collect()) == sorted(wanted)
