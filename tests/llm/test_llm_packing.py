"""Packing: every token once, no bin overfull, sizes the smallest that hold the contents."""

import random
from collections import defaultdict

from wattloom.llm.variable_packing import best_fit, cost, pack, pack_documents, pack_texts


def brute_best_fit(lengths, opened):
    bins = []
    for need in lengths:
        fits = [b for b in bins if b[0] >= need]
        if fits:
            chosen = min(fits, key=lambda b: b[0])
        else:
            chosen = [next(c for c in opened if c >= need), []]
            bins.append(chosen)
        chosen[0] -= need
        chosen[1].append(need)
    return sorted(sorted(b[1]) for b in bins)


def test_best_fit_leaves_the_least_room():
    rng = random.Random(0)
    for _ in range(40):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 80))), reverse=True)
        bins, _, fill = best_fit(lengths, [64])
        assert sorted(fill) == sorted(sum(b) for b in brute_best_fit(lengths, [64]))
        assert len(bins) == len(lengths)


def test_sizes_are_chosen_jointly():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 4096) for _ in range(500)), reverse=True)
    permitted = [256, 512, 1024, 2048, 4096]
    bins, _, sizes = pack(lengths, permitted)
    total = sum(cost(s) for s in {b: s for b, s in zip(bins, sizes)}.values())
    for k in range(len(permitted)):
        _, _, fill = best_fit(lengths, permitted[k:])
        assert total <= sum(cost(next(c for c in permitted if c >= f)) for f in fill)


def check(out, lengths, permitted):
    by_bin, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        if r["length"]:
            by_bin[r["bin_id"]].append(r)
        else:
            assert r["bin_id"] is None and r["bin_length"] is None
    for key, rows in by_doc.items():
        assert sorted((r["start"], r["length"]) for r in rows) == lengths[key]
    for rows in by_bin.values():
        rows.sort(key=lambda r: r["bin_offset"])
        place = 0
        for r in rows:
            assert r["bin_offset"] == place
            place += r["length"]
        assert {r["bin_length"] for r in rows} == {min(c for c in permitted if c >= place)}


def test_pieces_cover_documents(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 1, 5, 63, 64, 65, 200, None])) for k in range(300)] + [(1000, 6500)]
    lengths = {}
    for key, n in rows:
        n = n or 0
        lengths[key] = [(s, min(64, n - s)) for s in range(0, max(n, 1), 64)]
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id bigint, length bigint, bin_id string").repartition(3)
    for block in (1 << 14, 20):
        check(pack_documents(df, permitted=(16, 32, 64), block=block).collect(), lengths, (16, 32, 64))


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (2, ""), (3, " \n"), (4, "x " * 9000), (4, "x " * 9000)], "doc_id bigint, text string")
    out = pack_texts(df).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in out if r["length"] < 100) == [("1", 0), ("2", 0), ("3", 0), ("None", 2), ("None", 2)]
    assert sum(r["length"] for r in out if r["doc_id"] == 4) == 18000
    assert pack_texts(df.where("false")).count() == 0
