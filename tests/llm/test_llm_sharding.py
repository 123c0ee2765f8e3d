"""Exact shard sizes, uniformity and edge cases of the sharding operator."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wattloom.llm import sharding
from wattloom.llm.queries import QUERIES
from wattloom.llm.sharding import hypergeometric, matrix_row, shuffle_to_shards


def test_shards_hold_every_row_once(spark):
    rows = [(k % 40, None if k % 7 == 0 else f"t{k % 5}", k, "x") for k in range(503)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, _order string").repartition(5)
    out = shuffle_to_shards(df, 10).collect()
    sizes = Counter(r["shard"] for r in out)
    assert sorted(sizes) == list(range(10)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(10):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sizes[shard]))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in rows)


def test_many_cells_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 8)
    out = shuffle_to_shards(spark.range(400).selectExpr("id % 2 AS doc_id"), 3).collect()
    assert len(out) == 400
    for shard in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (133, 134)


def test_empty_table_and_fewer_rows_than_shards(spark):
    assert shuffle_to_shards(spark.range(0).selectExpr("id AS doc_id"), 4).count() == 0
    few = shuffle_to_shards(spark.range(3).selectExpr("id AS doc_id"), 40).collect()
    assert sorted(r["shard"] for r in few) == [0, 1, 2] and {r["slot"] for r in few} == {0}


def test_matrix_rows_add_up():
    sizes, goal = np.array([7, 0, 100, 13, 55]), [44, 44, 44, 43]
    matrix = np.array([matrix_row(sizes, goal, k, 3) for k in range(5)])
    assert (matrix.sum(axis=1) == sizes).all() and (matrix.sum(axis=0) == goal).all() and (matrix >= 0).all()


def test_permutation_is_uniform():
    # each entry of the matrix has the hypergeometric mean and variance over many seeds
    sizes, goal = np.array([30, 50, 20]), [50, 50]
    drawn = np.array([[matrix_row(sizes, goal, k, seed)[0] for k in range(3)] for seed in range(2000)])
    assert np.allclose(drawn.mean(axis=0), sizes / 2, atol=0.25)
    variance = sizes * 0.25 * (100 - sizes) / 99
    assert np.allclose(drawn.var(axis=0), variance, rtol=0.12)


def test_large_populations():
    rng = np.random.default_rng(0)
    good, bad, drawn = 3 * 10**9, 5 * 10**9, 2 * 10**9
    found = np.array([hypergeometric(rng, good, bad, drawn) for _ in range(300)], float)
    total = good + bad
    sd = (drawn * (good / total) * (bad / total) * (total - drawn) / (total - 1)) ** 0.5
    assert abs(found.mean() - drawn * good / total) < 5 * sd / 300**0.5 and 0.85 < found.std() / sd < 1.15


def test_columns_of_any_name(spark):
    own = ["_before", "_rank", "_cell", "_order", "_row", "part", "count"]
    df = spark.range(100).select(F.col("id").alias("doc_id"), *[(F.col("id") * 2).alias(c) for c in own], F.lit(-1).alias("Slot"))
    out = shuffle_to_shards(df, 3)
    assert out.columns == ["doc_id", *own, "shard", "slot"]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(100)) and all(r[c] == 2 * r["doc_id"] for r in rows for c in own)


def test_query_shards_whole_documents(spark, sf):
    """Digests against plain Python, gapless slots, and shards of equal size."""
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_sharding"](spark, sf).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want and len(rows) == len(want)
    slots = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(40)}
    assert all(s == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_reruns_agree(spark):
    df = spark.range(200).selectExpr("id AS doc_id").repartition(4, "doc_id")
    once = {tuple(r) for r in shuffle_to_shards(df, 7).collect()}
    assert once == {tuple(r) for r in shuffle_to_shards(df, 7).collect()}
