"""The run-length index and the removal of repeats against brute force."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattloom.llm import repeats
from wattloom.llm.blobs import dealt, gathered, xxhash_long
from wattloom.llm.repeats import GRAM, remove_repeats, winnow
from wattloom.llm.rl_index import RunIndex, doubled, first_ranks, suffix_array


def test_suffix_array(monkeypatch):
    rng = random.Random(0)
    for packed in (1 << 20, 0):
        monkeypatch.setattr("wattloom.llm.rl_index.PACKED", packed)
        for _ in range(30):
            text = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))] + [0]
            assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda k: text[k:])


def brute_matching(segments, owners, pattern, depth):
    out = []
    for i in range(len(pattern)):
        best = next((n for n in range(min(depth, len(pattern) - i), 0, -1) if any(pattern[i:i + n] in s for s in segments)), 0)
        out.append((best, min(o for s, o in zip(segments, owners) if pattern[i:i + depth] in s) if best == depth else None))
    return out


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(120):
        depth, letters = rng.choice([3, 5, 12, 20]), bytes(rng.sample(range(256), rng.choice([2, 3, 4]))) if rng.random() < 0.5 else b"\0\1a"
        make = lambda n: bytes(rng.choice(letters) for _ in range(n))
        segments = [make(rng.randint(1, 60)) for _ in range(rng.randint(1, 6))]
        owners = np.array([rng.randint(0, 9) for _ in segments])
        patterns = sorted((rng.choice(segments)[rng.randint(0, 3):] + make(rng.randint(0, 5)) + rng.choice(segments) + bytes([rng.randrange(256)]) for _ in range(5)), key=len, reverse=True)
        lengths, width = np.array([len(p) for p in patterns]), len(patterns[0])
        table = np.stack([np.frombuffer(p.rjust(width, b"\0"), np.uint8) for p in patterns])
        index, found = RunIndex(segments, owners, depth), [[None] * len(p) for p in patterns]
        for place, lanes, rows, matched in index.matching(table, lengths):
            smallest = index.smallest_owner(rows)
            for k in range(lanes):
                found[k][place - width + len(patterns[k])] = (int(matched[k]), int(smallest[k]) if matched[k] == depth else None)
        assert found == [brute_matching(segments, owners.tolist(), p, depth) for p in patterns]


def test_runs_are_fewer_in_repetitive_text():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcd") for _ in range(300))
    index = RunIndex([base[:k] + b"x" + base[k:] for k in range(0, 300, 10)], np.arange(30), 50)
    assert len(index.starts) < 0.2 * len(index.words)


def test_every_window_has_a_picked_gram():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(97, 100, 400), np.full(200, 97), rng.integers(0, 255, 300)]).astype(np.uint8)
    ends = np.full(len(text), len(text))
    at, _ = winnow(text, ends, 50)
    for w in range(len(text) - 49):
        assert ((at >= w) & (at + GRAM <= w + 50)).any()


def test_blobs():
    key, first, second = np.array([2, 0, 2, 2]), np.array([-5, 2**62, 3, -5]), np.array([1, 2, 3, 4])
    batch = dealt(key, [first, second], ("<i8", "<i4"))
    assert batch.column(0).to_pylist() == [0, 2]
    a, b = gathered(batch.column(1).to_pylist(), ("<i8", "<i4"))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(first.tolist(), second.tolist()))


def test_hash_is_that_of_sql(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select(F.xxhash64("v").alias("h")).collect()
    assert xxhash_long(np.array(values)).tolist() == [r["h"] for r in rows]


def brute(rows, size=50):
    big = 2**63 - 1
    first = {}
    for key, text in rows:
        data, key = (text or "").encode(), big if key is None else key
        for k in range(len(data) - size + 1):
            first[data[k:k + size]] = min(key, first.get(data[k:k + size], big))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        mark = bytearray(len(data))
        for k in range(len(data) - size + 1):
            if first[data[k:k + size]] < (big if key is None else key):
                mark[k:k + size] = b"\1" * size
        spans, k = [], 0
        while k < len(mark):
            if mark[k]:
                end = k
                while end < len(mark) and mark[end]:
                    end += 1
                spans.append((k, end))
                k = end
            else:
                k += 1
        out.append((key if key != big else None, len(data), sum(mark), len(spans), tuple(spans), bytes(c for c, m in zip(data, mark) if not m)))
    return sorted(out, key=str)


def found(df, **options):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], tuple((s["start"], s["stop"]) for s in r["spans"]), bytes(r["kept"])) for r in remove_repeats(df, **options).collect()), key=str)


def planted(rng, count, letters="abcdefgh é"):
    prose = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [prose(rng.randint(30, 140)) for _ in range(6)]
    rows = []
    for key in range(count):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(prose(rng.randint(0, 120)))
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 20):len(p) - rng.randint(0, 20)])
        rows.append((key, "".join(parts)))
    return rows + [(count + k, rng.choice(rows)[1]) for k in range(8)]


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many homes and blocks, queries in several parts, small slabs
        for name, value in (("HOME_BYTES", 2000), ("QUERY_BYTES", 500), ("SLAB", 300), ("HELD_ROWS", 50), ("PIECE", 60)):
            monkeypatch.setattr(repeats, name, value)
    rng = random.Random(5)
    rows = planted(rng, 60) + [(500, None), (501, ""), (502, "short"), (None, "zz " * 40), (None, "zz " * 40), (3, "zz " * 40), (503, "q" * 300), (504, "q" * 49), (505, "q" * 50), (506, "q" * 700), (7, planted(rng, 3)[0][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_bytes int, doc string").repartition(3)
    assert found(df) == brute(rows)


@pytest.mark.parametrize("size", [257, 300])
def test_windows_longer_than_a_piece(spark, size):
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = prose(1500)
    rows = [(key, prose(40 * key) + shared[30 * key:1500 - 20 * key] + prose(200)) for key in range(5)] + [(9, shared), (10, shared[:size - 60])]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string"), size=size) == brute(rows, size)


def test_whole_characters(spark):
    shared = "é" * 40
    rows = [(1, "aa" + shared), (2, "b" + shared[:30] + "ö" + shared)]
    out = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), characters=True).collect()}
    assert bytes(out[2]["kept"]).decode() and out[1]["kept"].decode() == rows[0][1]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_index_memory_per_byte():
    rng = np.random.default_rng(2)
    words = rng.integers(97, 123, (3000, 40)).astype(np.uint8)
    segments = [words[rng.integers(0, 3000, 6)].tobytes() for _ in range(2500)]
    tracemalloc.start()
    RunIndex(segments, np.arange(len(segments)), 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 130 * sum(map(len, segments))  # 173 bytes a byte, when all rows were compared at once in 64-bit numbers


def test_first_ranks_lead_to_the_same_suffix_array():
    rng = np.random.default_rng(4)
    for _ in range(60):
        letters = int(rng.choice([1, 2, 4, 256]))
        segments = [rng.integers(0, letters, rng.integers(0, 40)).astype(np.uint8).tobytes() for _ in range(rng.integers(1, 7))]
        segments += segments[:2]
        text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        symbols = text.astype(np.int32) + len(segments)
        symbols[ends] = np.arange(len(segments))
        left = (ends[np.repeat(np.arange(len(segments)), np.diff(ends, prepend=-1))] - np.arange(len(text))).astype(np.int32)
        assert doubled(*first_ranks(text, left)).tolist() == suffix_array(symbols).tolist()


def test_rows_of_one_document_are_dropped_before_the_sort(monkeypatch):
    rng = np.random.default_rng(6)
    count = 5000
    gram = np.concatenate([rng.integers(0, 2**47, count), np.arange(60)])  # the last 60 are also in another document
    gram = np.concatenate([gram, np.arange(60)])
    doc = np.concatenate([np.repeat(7, count + 60), np.repeat(2**63 - 1, 60)])
    place = np.arange(len(gram))
    columns = [doc, (gram >> 32), gram & 0xFFFFFFFF, place]
    blobs = dealt(place % 5, columns, repeats._GRAMS).column(1)
    rows = lambda: {k for b in repeats._grams(iter([pa.RecordBatch.from_arrays([blobs[k:k + 1]], ["blob"]) for k in range(5)])) for k in b.column(2).to_pylist()}
    shared = set(range(count, count + 120))
    assert shared <= rows() and len(rows()) < 0.5 * count
    monkeypatch.setattr(repeats, "HELD_BYTES", 0)  # too large to be held: all go on
    assert rows() == set(range(count + 120))


def test_matches_brute_force_in_small_chunks(spark, monkeypatch):
    rng = random.Random(11)
    rows = planted(rng, 40) + [(None, "yy " * 40), (4, "yy " * 40), (90, "q" * 300), (91, "q" * 120)]
    for held, chunk in ((0, 7), (500, 100)):
        for name, value in (("HELD_BYTES", held), ("CHUNK", chunk), ("ROWS", 100)):
            monkeypatch.setattr(repeats, name, value)
        assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == brute(rows)


def test_winnowing_memory_per_byte():
    text = np.random.default_rng(3).integers(97, 123, 2 << 20).astype(np.uint8)
    ends = np.full(len(text), len(text))
    tracemalloc.start()
    winnow(text, ends, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * len(text)  # 49 bytes a byte, when the hashes of a whole slab were held at once
