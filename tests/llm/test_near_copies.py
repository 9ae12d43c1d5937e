from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.accumulators import AccumulatorParam

from basketwise.llm import decontamination, jaccard_join
from basketwise.llm.components import components
from tests.llm.helpers import BASE, awkward, documents, shingles


def classes_of(rows):
    """Components by brute force over all pairs of (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    lowest = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 80 * len(sets[a] | sets[b]) and lowest[b] < lowest[a]:
                    lowest[a], changed = lowest[b], True
    return {i: (len(sets[i]), lowest[i]) for i in sets}


def corpus(seed):
    """Originals of several lengths with copies that have more and more words changed."""
    pick = random.Random(seed)
    passage = [f"gemeinsam{k}" for k in range(30)]
    rows = []
    for original in range(12):
        text = [f"w{original}_{pick.randrange(400)}" for _ in range(pick.choice([3, 6, 20, 90, 200]))]
        if original % 2:
            text += passage
        for _ in range(8):
            copy = list(text)
            for _ in range(pick.randrange(0, 1 + len(copy) // 12)):
                copy[pick.randrange(len(copy))] = f"neu{pick.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(copy)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = jaccard_join.similarity_classes(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == classes_of(rows)


def test_chain_of_links_is_one_class(spark):
    text = [f"k{k}" for k in range(100)]
    rows = []
    for step in range(6):
        rows.append((10 - step, " ".join(text)))
        text[step * 17] = f"anders{step}"
    found = {r.doc_id: r.component_id for r in jaccard_join.similarity_classes(documents(spark, rows)).collect()}
    assert set(found.values()) == {5}


def test_awkward_rows(spark):
    found = [tuple(r) for r in jaccard_join.similarity_classes(awkward(spark, extra=True)).collect()]
    assert len(found) == 13
    by_id = {i: (n, c) for i, n, c in found}
    assert by_id[1] == by_id[2] == (116, 1) and by_id[3] == (118, 1)
    assert by_id[4] == (0, 4) and by_id[5] == (0, 5) and by_id[6] == (0, 6)
    assert by_id[7] == (1, 7) and by_id[8] == (1, 7)
    assert by_id[9] == (39_996, 9) and by_id[None] == (116, 1)
    kept = jaccard_join.one_of_each(awkward(spark, extra=True))
    assert kept.columns == awkward(spark, extra=True).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10, 11]


def test_empty_tables(spark):
    nothing = documents(spark, [])
    assert jaccard_join.similarity_classes(nothing).collect() == []
    assert jaccard_join.one_of_each(nothing).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(awkward(spark), items).collect() == []
    assert decontamination.contained_items(nothing, items).collect() == []


def test_components_of_long_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(1, 60)]
    hub = [(500, k) for k in range(501, 540)] + [(501, 500), (600, 600), (None, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert {found[k] for k in range(1, 61)} == {1} and {found[k] for k in range(500, 540)} == {500}
    assert 600 not in found


def test_one_large_group_of_copies_is_not_paired(spark, monkeypatch):
    pick = random.Random(5)
    rows = []
    for k in range(300):
        copy = BASE.split()
        copy[pick.randrange(120)] = f"neu{k}"
        rows.append((k, " ".join(copy)))
    verified = []
    links = jaccard_join._Verifier.links
    monkeypatch.setattr(jaccard_join._Verifier, "links", lambda self, pairs: verified.append(pairs.count()) or links(self, pairs))
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    found = jaccard_join.similarity_classes(documents(spark, rows)).collect()
    assert {r.component_id for r in found} == {0}
    assert sum(verified) < 1_500  # all pairs are 44,850


def test_no_task_holds_a_template_whole(spark, monkeypatch):
    """Thousands of documents of one template: the rows that a task gets at once stay bounded."""
    pick = random.Random(8)
    rows = []
    for k in range(6_000):
        copy = BASE.split()[:60]
        copy[pick.randrange(60)] = f"neu{k}"
        rows.append((k, " ".join(copy)))

    def watched(function):
        def run(threshold):
            inner = function(threshold)

            def count(batches):
                seen = 0

                def counted():
                    nonlocal seen
                    for batch in batches:
                        seen += batch.num_rows
                        yield batch

                yield from inner(counted())
                sizes.add(seen)

            return count

        return run

    class Sizes(AccumulatorParam):
        def zero(self, value):
            return []

        def addInPlace(self, left, right):
            return left + (right if isinstance(right, list) else [right])

    sizes = spark.sparkContext.accumulator([], Sizes())
    monkeypatch.setattr(jaccard_join, "_linked", watched(jaccard_join._linked))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = jaccard_join.similarity_classes(documents(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.component_id for r in found} == {0}
    largest = sizes.value
    assert sum(largest) >= 6_000 and max(largest) < 0.6 * sum(largest)


def test_sets_of_one_name_are_told_apart(spark):
    rows = corpus(3)
    found = jaccard_join.similarity_classes(documents(spark, rows), name_bits=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == classes_of(rows)


def test_postings_without_a_partner_are_left_out():
    at = lambda n, place=0: n * jaccard_join.PLACE_SPAN + place
    postings = [(1, at(100), 5), (2, at(50), 6), (2, at(100), 7), (2, at(120), 8), (2, at(200), 9), (3, at(7), 10), (4, at(9), 11), (4, at(9), 12), (5, at(1), 13)]
    for size in (1, 2, 4, 9):
        batches = [
            pa.record_batch([pa.array(c, pa.int64()) for c in zip(*postings[k : k + size])], names=["shingle", "at", "group_id"])
            for k in range(0, len(postings), size)
        ]
        kept = [g for b in jaccard_join._with_partner(80)(iter(batches)) for g in b.column("group_id").to_pylist()]
        # The first and the last row of a task may have partners elsewhere.
        assert kept == [5, 7, 8, 11, 12, 13]


def items_in(docs, items, threshold=80):
    found = []
    for doc_id, text in docs:
        for item_id, item in items:
            size = min(5, len((item or "").encode().split()))
            wanted = shingles(item)
            if not wanted:
                continue
            raw = (text or "").encode().lower().split()
            have = {tuple(raw[k : k + size]) for k in range(len(raw) - size + 1)}
            if 100 * len(wanted & have) >= threshold * len(wanted):
                found.append((doc_id, item_id, len(wanted & have), len(wanted)))
    return sorted(found, key=str)


def test_contained_items_equal_brute_force(spark):
    pick = random.Random(3)
    items = [(k, " ".join(f"q{pick.randrange(500)}" for _ in range(pick.choice([1, 3, 5, 12, 40])))) for k in range(25)]
    items += [(99, None), (98, ""), (97, items[4][1])]
    docs = []
    for k in range(80):
        text = [f"q{pick.randrange(500)}" for _ in range(pick.choice([0, 4, 60, 900]))]
        passage = (pick.choice(items)[1] or "").split()
        for _ in range(pick.randrange(3)):
            if passage:
                passage[pick.randrange(len(passage))] = "anders"
        at = pick.randrange(len(text) + 1)
        docs.append((k, " ".join(text[:at] + [w.upper() for w in passage] + text[at:])))
    docs += [(None, docs[3][1]), (3, docs[3][1]), (200, None)]
    docs.append((201, " ".join(f"q{pick.randrange(500)}" for _ in range(30_000)) + " " + items[2][1] + " q1 " + items[4][1]))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = items_in(docs, items)
    assert len(want) > 20
    for block_bytes in (8 << 20, 200):
        found = decontamination.contained_items(documents(spark, docs, extra=True), table, block_bytes=block_bytes)
        assert sorted((tuple(r) for r in found.collect()), key=str) == want
    kept = decontamination.clean_documents(documents(spark, docs, extra=True), table)
    leaking = {i for i, *_ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i is None or i not in leaking)
