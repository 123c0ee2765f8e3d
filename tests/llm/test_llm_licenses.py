"""License scans: phrases against brute force, the gate against no gate, suppression and edge cases."""

import random
import re

import duckdb

from wattloom.llm.license_rules import PHRASES, _Covers, Scanner, rules, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in PHRASES:
        p = phrase.split()
        found += [(k, label) for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
    return len(words), sorted(found)


def test_hundreds_of_rules():
    assert len(rules()) > 200 and all(r.needs and 0 < r.confidence <= 1 for r in rules())


def test_gate_changes_nothing(sf):
    texts = [r[0].encode() for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' LIMIT 60").fetchall()]
    rng = random.Random(0)
    vocabulary = sorted({w.decode() for r in rules() for w in r.needs} | set("license licence licensed under the gnu v2 2 0 3 version public software by".split()))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(40)).encode() for _ in range(60)]
    gated, every = Scanner(), Scanner(gated=False)
    assert [gated.scan(t) for t in texts] == [every.scan(t) for t in texts]


def test_declared_identifiers():
    stated = {"MIT": "mit", "ISC": "isc", "MPL-2.0": "mpl-2", "EPL-2.0": "epl-2", "Zlib": "zlib", "GPL-2.0-or-later": "gpl-2", "BSD-3-Clause": "bsd-3",
              "CC-BY-SA-4.0": "cc-by-sa", "Apache-2.0": "apache-2", "MIT-0": "mit-0"}
    for name, label in stated.items():
        spans = Scanner().scan(f"// SPDX-License-Identifier: {name}\nint x;".encode())[2]
        assert [(s[0], s[2]) for s in spans] == [(0, label)], (name, spans)
    assert Scanner().scan(b"spdx license identifier nothing mit")[2] == []


def test_covers_against_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        covers, held = _Covers(), []
        for _ in range(40):
            a = rng.randrange(30)
            b = a + rng.randrange(1, 12)
            inside = any(x <= a and b <= y for x, y in held)
            assert covers.add(a, b) is not inside
            held += [] if inside else [(a, b)]


def test_places_of_words_and_many_detections():
    """Places as a plain count of the words before gives them; a text with 20,000 detections ends soon."""
    unit = "x released under the mit license and gpl v3 or cc by nc yes "
    count, base, spans = Scanner().scan((unit * 10_000).encode())
    words = WORD.findall(unit)
    assert count == len(words) * 10_000 and base[:2] == [(2, "mit"), (words.index("cc"), "cc-by-nc")] and len(base) == 20_000
    assert all(k % len(words) in (2, words.index("cc")) for k, _ in base)
    one = Scanner().scan(unit.encode())[2]
    assert [(a, b, label) for a, b, label, _ in spans[:len(one)]] == [(a, b, label) for a, b, label, _ in one] and len(spans) == 10_000 * len(one)
    assert spans[-1][0] == one[-1][0] + 9_999 * len(words) and words[one[0][0]] in ("released", "mit")


def test_phrases_and_columns(spark):
    texts = ["Released under the MIT License.", "UNDER THE MIT LICENSE under the mit license", "Apache License, Version 2.0 / CC-BY-NC 4.0", "cc by nc cc by nc", None, "", "...",
             "mitt under the mit licenses", "GNU General Public License v3", "É under the mit license", "x" * 50000 + " cc by nc"]
    rows = [(k, t, "z", 9) for k, t in enumerate(texts)] + [(None, texts[0], "z", 9), (0, texts[0], "z", 9)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string, labels string, n_words int")).collect()
    assert len(out) == len(rows)
    for r in out:
        count, base = brute(texts[r["doc_id"] or 0])
        assert (r["n_words"], r["n_base"]) == (count, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({b for _, b in base}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert [r["labels"] for r in out if r["doc_id"] == 8] == ["gpl-3"]


def test_contained_detections_are_suppressed():
    _, _, spans = Scanner().scan(b"This work is licensed under the GNU General Public License, version 3.")
    assert [s[2] for s in spans] == ["gpl-3"] and spans[0][3] == 0.95
    for a in spans:
        assert not any(b != a and b[0] <= a[0] and a[1] <= b[1] for b in spans)


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
