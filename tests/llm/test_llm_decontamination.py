"""Leaked benchmark passages against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from wattloom.llm import queries
from wattloom.llm.benchmark_leaks import Filter, find_leaks, judge, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_places(doc, item, window, shingle, containment):
    """First word and size of each place of ``doc`` that holds a window of ``item``."""
    out = set()
    size = min(window, len(item))
    wide = min(shingle, size)
    places = size - wide + 1
    for b in range(len(item) - size + 1) if item else ():
        for a in range(len(doc) - size + 1):
            same = sum(item[b + k:b + k + wide] == doc[a + k:a + k + wide] for k in range(places))
            if same >= math.ceil(containment * places):
                out.add((a, size))
    return out


def brute(docs, items, window=10, shingle=5, containment=1.0):
    out = []
    for key, text in docs:
        doc, hit, held = words(text), set(), set()
        for item, passage in items:
            places = brute_places(doc, words(passage), window, shingle, containment)
            hit |= {k for a, n in places for k in range(a, a + n)}
            held |= {str(item)} if places and item is not None else set()
        out.append((key, len(doc), len(hit), len(held), sorted(held) or None, bool(hit)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["key"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in df.collect()), key=repr)


def test_words_and_hashes():
    texts = ["Ab, c9-É x\x7fy z", "", "..", "É x", "c9 É x", "word " * 3]
    made = words_of([t.encode() for t in texts])
    assert [made.joined(k, k + 1).decode() for k in range(len(made.hash))] == [w for t in texts for w in words(t)]
    assert made.owner.tolist() == [n for n, t in enumerate(texts) for _ in words(t)]
    by_word = {}
    for k, h in enumerate(made.hash.tolist()):
        assert by_word.setdefault(made.joined(k, k + 1), h) == h
    assert len(set(by_word.values())) == len(by_word)
    at, hashes = made.shingles(2)
    pairs = [made.joined(k, k + 2) for k in at.tolist()]
    assert len(set(zip(pairs, hashes.tolist()))) == len(set(pairs)) == len(set(hashes.tolist()))
    assert all(made.owner[k] == made.owner[k + 1] for k in at)


def test_words_longer_than_a_slab(monkeypatch):
    monkeypatch.setattr("wattloom.llm.benchmark_leaks.SLAB", 16)
    texts = [b"short " + b"x" * 100 + b" tail word", b"short", b"x" * 100 + b" tail"]
    made = words_of(texts)
    assert made.hash[0] == made.hash[4] and made.hash[1] == made.hash[5] and made.hash[2] == made.hash[6]


def test_filter_has_no_false_negatives():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(3)
    map_ = np.zeros(1 << 10, np.uint64)
    for h in hashes.tolist():
        for place in (h >> 48, h & 0xFFFF):
            map_[place >> 6] |= np.uint64(1 << (place & 63))
    assert Filter(16, map_).has(hashes).all()
    assert not Filter(16, np.zeros(1 << 10, np.uint64)).has(hashes).any()


def planted(rng, few="abcd"):
    items = [(k, " ".join(rng.choice(few) for _ in range(rng.choice([0, 1, 3, 7, 10, 11, 25])))) for k in range(12)]
    items += [(3, items[0][1]), (77, items[5][1]), (None, "lost words")]
    docs = []
    for k in range(40):
        parts = [" ".join(rng.choice(few + "xyz") for _ in range(rng.randint(0, 12))) for _ in range(3)]
        parts.insert(1, rng.choice(items)[1].upper())
        docs.append((k % 30, ", ".join(parts)))
    return docs + [(None, docs[1][1]), (None, docs[1][1]), (5, None), (5, ""), (6, "...")], items


@pytest.mark.parametrize("window,shingle,containment", [(10, 5, 1.0), (10, 5, 0.5), (6, 2, 0.8), (4, 4, 1.0), (5, 1, 0.6)])
def test_judge_matches_brute_force(spark, window, shingle, containment):
    docs, items = planted(random.Random(window * 10 + shingle))
    frames = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert found(judge(*frames, window=window, shingle=shingle, containment=containment)) == brute(docs, items, window, shingle, containment)


def test_spans_are_merged_runs(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = [(1, f"a {item} b {item}"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (3, f"{item} {item}")]
    out = judge(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([("x", item)], "item_id string, text string"))
    assert {r["key"]: r["hit_spans"] and [tuple(s) for s in r["hit_spans"]] for r in out.collect()} == {1: [(1, 12), (14, 25)], 2: None, 3: [(0, 23)]}


def test_empty_tables_clashing_names_and_large_joins(spark, monkeypatch):
    rng = random.Random(4)
    docs, items = planted(rng)
    wide = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id int, text string, row int, hash int, window int")
    listed = spark.createDataFrame(items, "item_id int, text string")
    assert found(judge(wide.where("false"), listed)) == []
    assert found(judge(wide, listed.where("false"))) == brute(docs, [])
    monkeypatch.setattr("wattloom.llm.benchmark_leaks.small_side", lambda df: df)  # as with prefixes too many to broadcast
    assert found(judge(wide, listed)) == brute(docs, items)


def test_only_the_rarest_shingles_are_looked_up(spark):
    common = "the cat sat on the mat"
    docs = [(k, common) for k in range(50)] + [(99, f"{common} q r s t")]
    leaks = find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, f"{common} q r s t")], "item_id int, text string"))
    assert leaks.spans.count() == 1


def test_registered_query_matches_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {}
    for item, passage in items:
        w = words(passage)
        for b in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[b:b + 10]), set()).add(str(item))
    expected = []
    for key, text in docs:
        doc, hit, held = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for a in range(len(doc) - size + 1):
                if tuple(doc[a:a + size]) in windows:
                    hit |= set(range(a, a + size))
                    held |= windows[tuple(doc[a:a + size])]
        expected.append((key, len(doc), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    out = queries.QUERIES["op11_decontamination"](spark, sf)
    got = [tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got) == sorted(expected)
    assert any(r[5] for r in got)
