"""Ball k-means codes against plain k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from wattloom.llm import queries
from wattloom.llm.vector_codes import Codebook, assign, compress, largest, with_label_error

NOT_NUMBERS = (float("nan"), float("inf"), -float("inf"), None)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes, errors and digest by comparing every part with every entry, in Python numbers."""
    kept = [(k, v, lab) for k, v, lab in rows if v and not any(x is None or math.isnan(x) or math.isinf(x) for x in v)]
    width = len(kept[0][1])
    cuts = [p * width // parts for p in range(parts + 1)]
    whole = [[math.floor(x * scale) for x in v] for _, v, _ in kept]
    first = [w for _, w in sorted(zip(((k is None, k or 0) for k, _, _ in kept), whole), key=lambda x: (x[0], x[1]))][:entries]
    codes, books = [[0] * parts for _ in kept], []
    errors = [0] * len(kept)
    for p in range(parts):
        cut = slice(cuts[p], cuts[p + 1])
        book, vectors = [w[cut] for w in first], [w[cut] for w in whole]
        for step in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book)) for v in vectors]
            if step < rounds:
                for j in range(len(book)):
                    members = [v for v, (_, c) in zip(vectors, near) if c == j]
                    book[j] = [sum(x) // len(members) for x in zip(*members)] if members else book[j]
        books += [x for e in book for x in e]
        for n, (d, c) in enumerate(near):
            codes[n][p] = c
            errors[n] += d
    sums = {}
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((k, bytes(c).hex(), e, sums[lab]) for (k, _, lab), c, e in zip(kept, codes, errors)), key=repr), hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def found(codes):
    return sorted(((r["key"], r["code"].hex(), r["error"], r["label_error"]) for r in with_label_error(codes).collect()), key=repr), codes.books_sha256()


def test_assignments_match_all_distances():
    rng = np.random.default_rng(0)
    for trial in range(60):
        many, width, spread = int(rng.integers(1, 17)), int(rng.integers(1, 5)), int(rng.choice([3, 50, 2000]))
        centres = rng.integers(-spread, spread, (6, width)) * 5
        parts = centres[rng.integers(0, 6, 300)] + rng.integers(-spread // 3, spread // 3 + 1, (300, width))
        entries = parts[rng.integers(0, 300, many)].copy()
        codes, radii, moved = np.zeros(300, np.int64), np.full(many, 1 << 50), np.ones(many, bool)
        for _ in range(6):
            codes, radii, work = assign(parts, codes, radii, Codebook(entries, moved))
            distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
            assert codes.tolist() == distance.argmin(axis=1).tolist()  # the first of equal ones
            assert all(radii[j] >= distance[codes == j, j].max(initial=0) for j in range(many))
            old = entries.copy()
            for j in set(codes.tolist()):
                entries[j] = parts[codes == j].sum(axis=0) // (codes == j).sum()
            moved = (old != entries).any(axis=1)
        if not moved.any():
            assert assign(parts, codes, radii, Codebook(entries, moved))[2] == 0  # all balls are stable


def test_fewer_distances_than_plain_k_means():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (16, 8))
    parts = centres[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 8))
    codes, radii, _ = assign(parts, np.zeros(4000, np.int64), np.full(16, 1 << 50), Codebook(centres, np.ones(16, bool)))
    moved = centres + 1
    again, _, work = assign(parts, codes, radii, Codebook(moved, np.ones(16, bool)))
    assert work < 1.5 * len(parts)
    assert again.tolist() == ((parts[:, None] - moved[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()


@pytest.mark.parametrize("parts,entries,rounds,width", [(8, 16, 6, 16), (4, 5, 3, 10), (3, 200, 2, 2)])
def test_compress_matches_brute_force(spark, parts, entries, rounds, width):
    rng = random.Random(width)
    rows = [(k, [round(rng.gauss(k % 3, 0.3), rng.choice([1, 6])) for _ in range(width)], rng.choice([0, 1, None])) for k in range(120)]
    rows += [(7, rows[9][1], 2), (7, rows[9][1], 2), (None, rows[3][1], None), (900, rows[1][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    assert found(compress(frame, parts=parts, entries=entries, rounds=rounds)) == brute(rows, parts, entries, rounds)


def test_odd_vectors_and_empty_tables(spark):
    rng = random.Random(9)
    good = [(k, [rng.random() for _ in range(8)], None) for k in range(30)]
    bad = [(100 + n, [0.5] * 7 + [x], 1) for n, x in enumerate(NOT_NUMBERS)] + [(200, None, 1), (201, [], 1), (202, [0.1] * 9, 1)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in good + bad], "vec_id bigint, embedding array<double>, label int, key int, code int, v int")
    assert found(compress(frame)) == brute(good)
    empty = compress(frame.where("false"))
    assert empty.rows.count() == 0 and [b.shape[0] for b in empty.books] == [0] * 8
    huge = spark.createDataFrame([(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), (3, [0.0] * 8, 1)], "vec_id bigint, embedding array<double>, label int")
    most = largest(8, 8, 1)
    assert sorted(r["error"] for r in compress(huge, entries=1, rounds=0).rows.collect()) == [0, 8 * most**2, 8 * (2 * most) ** 2]


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("wattloom.llm.common.checkpoint_folder", lambda session: str(tmp_path))
    frame = spark.createDataFrame([(k, [float(k)] * 8, 0) for k in range(20)], "vec_id bigint, embedding array<double>, label int")
    compress(frame, rounds=3)
    assert len(list(tmp_path.glob("table-*"))) == 1


def test_registered_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    out = queries.QUERIES["op13_codes"](spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    expected, sha = brute(rows)
    assert sorted((tuple(r)[:4] for r in out), key=repr) == expected
    assert {r["codebooks_sha256"] for r in out} == {sha}
