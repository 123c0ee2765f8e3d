"""The trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest

from wattloom.llm import prefix_trie, queries
from wattloom.llm.prefix_trie import common_turns, pack_turns, trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute_trie(conversations):
    """Rows of the trie of (key, list of (role, text))."""
    nodes = {}
    for key, turns in conversations:
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((key, len(turns) == d))
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        found = [below(c) for c in children.get(path, [])]
        size = len(path[-1][1].encode()) if path else 0
        return sum(f[0] for f in found) or 1, sum(f[1] for f in found) + (len(nodes[path]) - 1) * size

    out = []
    for path, members in nodes.items():
        leaves, saved = below(path)
        ends = ",".join(str(k) for k in sorted(k for k, end in members if end))
        parent = min(k for k, _ in nodes[path[:-1]]) if path else None
        out.append((min(k for k, _ in members), len(path), parent, len(members), len(children.get(path, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(rng, count, letters="abc", longest=6):
    return [(k, [(rng.choice(["user", ""]), rng.choice(letters) * rng.randint(0, 3) + rng.choice(["", "é"])) for _ in range(rng.randint(0, longest))]) for k in range(count)]


def rows_of(conversations):
    return [(key, n, role, text) for key, turns in conversations for n, (role, text) in enumerate(turns)]


def test_common_turns():
    a, b = bytes(range(40)), bytes(range(20)) + bytes(20)
    assert [common_turns(a, a), common_turns(a, b), common_turns(b"", a), common_turns(a[:20], a), common_turns(b[20:], a)] == [2, 1, 0, 1, 0]


@pytest.mark.parametrize("range_bytes", [60, 400, 1 << 21])
def test_trie_matches_brute_force(spark, range_bytes):
    rng = random.Random(range_bytes)
    talks = [(k, t) for k, t in made(rng, 60, "ab", 5) if t]
    talks += [(1000 + k, talks[0][1]) for k in range(30)] + [(2000, [("user", "x")] * 40), (2001, [("user", "x")] * 40 + [("", "y")])]
    assert found(trie(pack_turns(spark.createDataFrame(rows_of(talks), SCHEMA)), range_bytes=range_bytes)) == brute_trie(talks)


def test_digest_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    talks = [(k, [("user", "hot")]) for k in range(200)] + [(500, [("user", "hot"), ("", "more")]), (501, [])]
    paths = pack_turns(spark.createDataFrame(rows_of(talks), SCHEMA)).union(spark.createDataFrame([(501, bytearray())], "conv_id bigint, path binary"))
    assert found(trie(paths, range_bytes=300)) == brute_trie(talks)


def test_edge_cases(spark):
    rows = [(1, None, "user", None), (1, 0, None, "b"), (1, 0, "a", "b"), (1, 0, "a", "b"), (None, 3, "user", "lost"), (2, 5, "x", "é" * 100_000), (2, 5, "w", "tie")]
    talks = [(1, [("user", ""), ("", "b"), ("a", "b"), ("a", "b")]), (2, [("w", "tie"), ("x", "é" * 100_000)])]
    frame = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA + ", path int, step int")
    assert found(trie(pack_turns(frame))) == brute_trie(talks)
    assert found(trie(pack_turns(frame.where("false")))) == []
    role_and_text = [(1, 0, "ab", "c"), (2, 0, "a", "bc")]
    assert found(trie(pack_turns(spark.createDataFrame(role_and_text, SCHEMA)))) == brute_trie([(1, [("ab", "c")]), (2, [("a", "bc")])])


def brute_rebuilt(turns):
    whole = {}
    for key, turn, role, text in sorted(turns, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        whole.setdefault(key, []).append((role or "", text or ""))
    return [(c, whole.get(c - c % 5, [])[:(h := zlib.crc32(str(c).encode()) % 9)] + own[h:]) for c, own in whole.items()]


def test_registered_query_matches_brute_force(spark, sf, tmp_path):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.QUERIES["op12_trie"](spark, sf)) == brute_trie(brute_rebuilt(turns))
    odd = [(k, n if n else None, "user" if n % 2 else None, f"t{k % 3}{n}") for k in (*range(3, 40), 1005, 10_000_019) for n in range(k % 12)] + [(50, 0, None, None)]
    spark.createDataFrame(odd, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(queries.QUERIES["op12_trie"](spark, str(tmp_path))) == brute_trie(brute_rebuilt(odd))
