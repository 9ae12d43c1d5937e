"""The prefix trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from basketwise.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place long, name string, words long, rep long, depth long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, 3, 4) for r in rows], SCHEMA)


def by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own.setdefault(conv, []).append((turn is not None, turn or 0, name, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, len(whole)))
    result = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(o[: len(k)] == k and len(o) == len(k) + 1 for o in nodes)]
        saved = sum((len(nodes[k]) - 1) * len(k[-1][1].encode().split()) for k in below if k)
        ends = ",".join(str(c) for c, n in sorted(members) if n == len(key))
        parent = min(nodes[key[:-1]])[0] if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        result.append((min(members)[0], len(key), parent, len(members), len(kids), len(leaves), saved, digest))
    return sorted(result, key=str)


def talk(seed, convs=60, most=9):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(400), convs):
        for turn in range(pick.randrange(1, most)):
            rows.append((c, turn, "ua"[turn % 2], pick.choice(["hi", "a b c", "x y", "some more words"])))
    pick.shuffle(rows)
    return rows


AWKWARD = [
    (None, 0, "user", "nobody"),
    (0, None, "user", "first"),
    (0, 3, "user", "b"),
    (0, 3, "user", "a"),
    (0, 3, "user", "a"),
    (3, 0, None, None),
    (3, 1, "", ""),
    (4, 0, "u:", "ser"),
    (5, 0, "u", ":ser"),
    (6, 1, "user", "word " * 30_000),
    (7, 1, "user", "word " * 30_000 + "x"),
    (27, 0, "user", "q"),
    (47, 0, "user", "q"),
    (47, 1, "user", "r"),
    (-3, 0, "user", "q"),
]


@pytest.mark.parametrize(
    "rows, chunk",
    [
        (talk(1), 512),
        (talk(2, 40), 2),
        (talk(3, 25, 30), 4),
        (AWKWARD, 512),
        (talk(4, 10) + [(500 + c, t, "u", "same") for c in range(30) for t in range(17)], 8),
        ([(c, 0, "u", "q") for c in range(40)], 512),
    ],
)
def test_trie_equals_a_plain_one(spark, rows, chunk):
    found = prefix_trie.conversation_trie(conversations(spark, rows).repartition(3), chunk).collect()
    wanted = [r for r in rows if r[0] is None or r[0] >= 0]
    if len(wanted) < len(rows):
        # The remainder of a negative number has its sign, so its family is that of 0.
        assert any(r.conv_id == -3 for r in found)
        found = prefix_trie.conversation_trie(conversations(spark, wanted), chunk).collect()
    assert sorted((tuple(r) for r in found), key=str) == by_hand(wanted)


def test_nothing_gives_no_nodes(spark):
    for rows in ([], [(None, 0, "user", "x")]):
        assert prefix_trie.conversation_trie(conversations(spark, rows)).collect() == []


def test_long_conversation_is_spread_over_rows(spark):
    """Chunked and whole sequences lead to the same trie."""
    # Two conversations that skip nothing of their own.
    first, second = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 0][:2]
    rows = [(first, t, "u", str(t % 7)) for t in range(300)] + [(second, t, "u", str(t % 7)) for t in range(256)]
    rows += [(1041, t, "u", str(t)) for t in range(3)]
    tries = [prefix_trie.conversation_trie(conversations(spark, rows), chunk).collect() for chunk in (8, 512)]
    assert sorted(map(tuple, tries[0]), key=str) == sorted(map(tuple, tries[1]), key=str)
    assert max(r.n_convs for r in tries[0] if r.depth == 250) == 2


def test_equal_prefixes_have_equal_names():
    rng = np.random.default_rng(1)
    turns = rng.integers(0, 1 << 60, (40, 2), dtype=np.uint64)
    lengths = np.array([5, 40, 1, 16, 15, 33])
    names = np.concatenate([turns[:n] for n in lengths])
    before, after = prefix_trie.prefix_names(lengths, names, np.zeros((6, 2), np.uint64))
    first = 0
    known = {}
    for n in lengths:
        for d in range(n):
            assert known.setdefault(d, before[first + d].tobytes()) == before[first + d].tobytes()
            assert known.setdefault(d + 1, after[first + d].tobytes()) == after[first + d].tobytes()
        first += n
    assert len(set(known.values())) == len(known)
