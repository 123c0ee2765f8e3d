"""Fingerprints and groups of the SimHash operator against brute force."""

import random
import re

import xxhash

from wattloom.llm.covering_simhash import covering_masks, fingerprint, near_duplicates, near_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(keys, prints, radius=3):
    label = list(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    first = {}
    for key, lab in zip(keys, label):
        first[lab] = min([k for k in (first.get(lab), key) if k is not None], default=None)
    return [first[lab] for lab in label]


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(0)
    for radius in (1, 2, 3):
        masks = covering_masks(radius, list(range(64)))
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            differ = sum(1 << p for p in rng.sample(range(64), radius))
            assert any(not differ & m for m in masks)


def test_fingerprints_match_brute_force():
    texts = ["", " \t\n", "One", "one TWO", "a b c", "Ä É straße ÉTÉ\x0bx\x1fy z", "the cat sat on the mat " * 50, "x y z w"]
    assert [fingerprint(t.encode(), 3, 42) for t in texts] == [brute_fingerprint(t) for t in texts]


def _planted(rng, count):
    base = [rng.getrandbits(64) for _ in range(count)]
    for value in list(base):
        for _ in range(rng.randint(0, 4)):
            for p in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << p
            base.append(value)
    return base


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(1)
    prints = sorted(set(_planted(rng, 60)) | {7 << 40 | k for k in range(40)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    fps = spark.createDataFrame(signed, "fp bigint")
    wanted = brute_groups(prints, prints)
    for split_above in (2048, 2):
        links = [(u % (1 << 64), v % (1 << 64)) for u, v in near_links(fps, 3, split_above).collect()]
        assert all((u ^ v).bit_count() <= 3 for u, v in links)
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in links:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        found = [find(p) for p in prints]
        assert [[x == y for y in found] for x in found] == [[x == y for y in wanted] for x in wanted]


def test_groups_of_documents(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(30):
        text = [rng.choice(words) for _ in range(300)]
        for copy in range(rng.randint(1, 3)):
            near = list(text)
            if copy:
                near[rng.randrange(300)] = "changed"
            rows.append((len(rows), " ".join(near), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n", None), (None, rows[0][1], "x"), (None, "all alone here", "x"), (5, rows[5][1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    out = near_duplicates(df).collect()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(((k, p, g) for (k, _, _), p, g in zip(rows, prints, brute_groups([r[0] for r in rows], prints))), key=str)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in out), key=str) == want


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
