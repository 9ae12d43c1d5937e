"""The two vector operators against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from basketwise.llm import centroids, topk
from basketwise.llm.vectors import whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row long, vector string, cluster int, score string"
BY_FIVE = "vec_id % 5 = 0"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "v", 3, "s") for i, v in rows], SCHEMA)


def clouds(seed, n, size=64, copies=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.12, (6, size))
    rows = [(int(i) * 3 - 40, (middles[rng.integers(6)] + rng.normal(0, 0.06, size)).tolist()) for i in rng.permutation(n)]
    return rows + [(1000 + i, rows[0][1]) for i in range(copies)]


def whole(rows, size=None):
    kept = []
    for i, v in rows:
        if v is None or (size is not None and len(v) != size) or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    return kept


def best_by_hand(rows, k):
    result = []
    last = 1 << 62
    for a, (i, q) in enumerate(rows):
        if i is None or i % 5:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), last if j is None else j) for b, (j, v) in enumerate(rows) if b != a]
        result += [(i, r, None if j == last else j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(result, key=str)


ODD = [
    (5, None),
    (None, [0.5] * 64),
    (11, []),
    (15, [0.25, -0.5]),
    (20, [float("nan")] * 64),
    (25, [0.1] * 63 + [None]),
    (30, [float("inf")] + [0.1] * 63),
    (35, [0.0] * 64),
    (40, [0.5] * 64),
    (40, [0.5] * 64),
    (45, [0.5] * 65),
    (50, [1e6] * 64),
]


@pytest.mark.parametrize("rows, shard_rows", [(clouds(1, 400, copies=60), 64), (clouds(2, 90), 4096), (clouds(3, 30) + ODD[:-1], 16)])
def test_best_matches_equal_brute_force(spark, rows, shard_rows):
    found = topk.best_matches(whole_vectors(embeddings(spark, rows)), BY_FIVE, 7, shard_rows, query_bytes=9000).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in found), key=str) == best_by_hand(whole(rows), 7)


def test_vectors_too_large_for_whole_numbers_take_no_part(spark):
    assert [r.vec_id for r in whole_vectors(embeddings(spark, ODD)).collect()] == [None, 11, 15, 35, 40, 40, 45]


def test_search_stops_before_all_classes():
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(0, 8, (3000, 64))).astype(np.int64)
    index = topk.ImpactIndex(np.arange(3000), np.arange(3000), vectors)
    own = np.arange(0, 3000, 100)
    found = {own[n]: (rows, scores) for n, rows, _, scores in index.search(vectors[own], own, 20)}
    assert len(found) == 30
    for number, (rows, scores) in found.items():
        exact = vectors @ vectors[number]
        exact[number] = exact.min() - 1
        assert rows.tolist() == np.lexsort((np.arange(3000), -exact))[:20].tolist()
        assert scores.tolist() == exact[rows].tolist()
    assert index.products < 0.9 * 30 * 3000 * len(index.classes) and index.rescored < 0.3 * 30 * 3000


@pytest.mark.parametrize("scale", [1, 1 << 11, 1 << 23])
def test_scores_of_any_size_are_whole(scale):
    rng = np.random.default_rng(6)
    vectors = rng.integers(-scale, scale + 1, (300, 8))
    index = topk.ImpactIndex(np.arange(300), np.arange(300), vectors)
    for number, rows, _, scores in index.search(vectors[:40], np.arange(40), 5):
        exact = [(-int(sum(int(a) * int(b) for a, b in zip(v, vectors[number]))), n) for n, v in enumerate(vectors) if n != number]
        assert [(-int(s), int(r)) for s, r in zip(scores, rows)] == sorted(exact)[:5]


def test_copies_are_one_entry_of_the_index():
    vectors = np.array([[1, 2]] * 500 + [[2, 1]])
    index = topk.ImpactIndex(np.arange(501), np.arange(501)[::-1].copy(), vectors)
    [(_, rows, ids, scores)] = index.search(np.array([[1, 1]]), np.array([3]), 4)
    assert len(index.vectors) == 2 and ids.tolist() == [0, 1, 2, 3] and scores.tolist() == [3] * 4


def test_no_vectors_and_no_queries(spark):
    for rows in ([], [(3, [0.1] * 64)], [(5, [0.1] * 64)], [(5, None)]):
        assert topk.best_matches(whole_vectors(embeddings(spark, rows)), BY_FIVE).collect() == []


def clusters_by_hand(rows, k, rounds):
    def place(i):
        return ("~", "") if i is None else (hashlib.sha256(f"1:{i}".encode()).hexdigest(), "")

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middles))

    middles = [v for _, v in sorted(rows, key=lambda r: (place(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        middles = [[sum(c) // len(c) for c in zip(*groups[n])] if n in groups else middles[n] for n in range(len(middles))]
    found = [(i, *nearest(v)) for i, v in rows]
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in found), key=str)


@pytest.mark.parametrize("rows", [clouds(4, 300, copies=100), clouds(5, 9), clouds(6, 40) + ODD, [(k, [0.5] * 64) for k in range(30)]])
def test_clusters_equal_brute_force(spark, rows):
    found = centroids.clusters_of(whole_vectors(embeddings(spark, rows), 64).repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=str) == clusters_by_hand(whole(rows[:-1] if rows[-1] == ODD[-1] else rows, 64), 16, 3)


def test_clusters_of_nothing(spark):
    assert centroids.clusters_of(whole_vectors(embeddings(spark, [(1, None)]), 64)).collect() == []


def test_search_rejects_most_centroids():
    rng = np.random.default_rng(7)
    middles = np.floor(rng.normal(0, 10, (16, 64)) + rng.normal(0, 6, (16, 1))).astype(np.int64)
    vectors = middles[rng.integers(16, size=2000)] + rng.integers(-3, 4, (2000, 64))
    search = centroids.Search(middles)
    numbers, distance = search.nearest(vectors)
    exact = ((vectors[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (numbers == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert search.evaluated < 0.6 * exact.size


def test_ties_go_to_the_smaller_number():
    search = centroids.Search(np.array([[9, 9], [0, 2], [2, 0], [0, 2]]))
    numbers, distance = search.nearest(np.array([[0, 0], [1, 1], [2, 2]]))
    assert numbers.tolist() == [1, 1, 1] and distance.tolist() == [4, 2, 4]
