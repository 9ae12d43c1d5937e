import random
from collections import Counter
from functools import partial
from itertools import combinations

import pytest

from basketwise import session
from basketwise.operators import baskets
from checks.queries import REGISTERED
from tests.conftest import as_dicts


def brute_pairs(rows):
    groups = {}
    for hshd, basket, _, product, *_ in rows:
        if None not in (hshd, basket, product):
            groups.setdefault((hshd, basket), set()).add(product)
    counts = Counter()
    for products in groups.values():
        for pair in combinations(sorted(products, key=str), 2):
            counts[pair] += 1
    return counts


def as_counts(df):
    rows = df.collect()
    counts = {(r["product1"], r["product2"]): r["count"] for r in rows}
    assert len(counts) == len(rows)
    return counts


@pytest.fixture(scope="module")
def skewed():
    """One basket holds a third of the lines, and one product is in half the baskets."""
    rng = random.Random(7)
    rows = [(1, 1, "2018-01-01", rng.randrange(60), 1, 1, "r") for _ in range(150)]
    for basket in range(2, 90):
        rows += [(basket % 20, basket, "2018-01-01", rng.randrange(60), 1, 1, "r") for _ in range(3)]
        if basket % 2:
            rows.append((basket % 20, basket, "2018-01-01", 7, 1, 1, "r"))
    return rows


def test_pair_order_is_textual(lines):
    frame = lines([(1, 1, "2018-01-01", p, 1, 1, "r") for p in (9, 10, 10)] + [(1, 2, "2018-01-01", 5, 1, 1, "r")])
    assert as_counts(baskets.basket_pairs(frame)) == {(10, 9): 1}
    assert as_dicts(baskets.multi_item_baskets(frame)) == [{"hshd_num": 1, "basket_num": 1, "products": 2}]


def test_no_pairs(lines):
    frame = lines([(1, 1, "2018-01-01", 5, 1, 1, "r"), (None, 1, "2018-01-01", 6, 1, 1, "r")])
    assert baskets.basket_pairs(frame).collect() == []
    assert baskets.top_pairs(frame).collect() == []


@pytest.mark.parametrize("block", [2, 7, 2048])
def test_wide_baskets_are_cut_into_blocks(lines, skewed, block):
    assert as_counts(baskets.basket_pairs(lines(skewed), block)) == brute_pairs(skewed)


@pytest.mark.parametrize("n,seeds", [(5, 3), (20, 10), (200, 256), (5000, 4)])
@pytest.mark.parametrize("direct", [0, 10**6])
def test_top_pairs_equal_ranking_all_pairs(lines, skewed, n, seeds, direct):
    ranked = sorted(brute_pairs(skewed).items(), key=lambda item: (-item[1], item[0]))[:n]
    found = [((r["product1"], r["product2"]), r["count"]) for r in baskets.top_pairs(lines(skewed), n, seeds, 8, direct).collect()]
    assert found == ranked


@pytest.fixture
def three_pairs(spark):
    return spark.createDataFrame([(1, 2, 4), (1, 3, 2), (2, 3, 2)], "product1 bigint, product2 bigint, count bigint")


@pytest.fixture
def details(spark):
    return spark.createDataFrame(
        [(1, 0.5, "FOOD", "DAIRY"), (2, 0.5, "FOOD", "MEAT")],
        "product_num bigint, frequency double, department string, commodity string",
    )


def test_recommend(spark, three_pairs, details):
    wanted = spark.createDataFrame([(1, 1), (1, 2), (2, 99), (3, 1), (3, 1), (3, 2)], "basket_id bigint, product_num bigint")
    recs = baskets.recommendations(three_pairs)
    rows = baskets.ordered_recommendations(baskets.recommend(wanted, recs, details)).collect()
    found = {(r["basket_id"], r["product_num"]): r["score"] for r in rows}
    # Basket 3 lists product 1 twice, so its edges count twice.
    assert found == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): 1.0, (3, 2): 1.0, (3, 1): 0.5, (3, 3): 0.75}
    unknown = next(r for r in rows if r["product_num"] == 3)
    assert (unknown["department"], unknown["commodity"]) == ("Unknown", "Unknown")
    fresh = baskets.recommend(wanted, recs, details, exclude_owned=True).collect()
    assert {(r["basket_id"], r["product_num"]): r["score"] for r in fresh} == {(1, 3): 1.0, (3, 3): 1.0}


def test_recommendations_hold_every_pair(spark, tmp_path):
    """Baskets with more pairs than a list of top pairs has: each is an edge both ways, ranked by count, then number."""
    bought = [(1, n) for n in range(22)] + [(2, n) for n in (3, 4, 100, 101)]
    rows = [(order, product, line) for line, (order, product) in enumerate(bought)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5), (2, 5)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    counts = Counter()
    for order in (1, 2):
        for pair in combinations([product for number, product in bought if number == order], 2):
            counts.update([pair, pair[::-1]])
    expected = {}
    for src in {src for src, _ in counts}:
        own = sorted((-count, dst) for (other, dst), count in counts.items() if other == src)
        expected |= {(src, dst): (-count, rank) for rank, (count, dst) in enumerate(own, 1)}
    found = REGISTERED["recommendations"](spark, str(tmp_path)).collect()
    assert len(found) == len(expected) > 2 * baskets.TOP_PAIRS
    assert {(r["src"], r["dst"]): (r["count"], r["rank"]) for r in found} == expected


def test_recommendations_are_ranked(three_pairs):
    rows = {(r["src"], r["rank"]): r["dst"] for r in baskets.recommendations(three_pairs).collect()}
    assert rows == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2}


def test_top_product_pairs(three_pairs, details):
    top = baskets.top_product_pairs(baskets.recommendations(three_pairs), details, k=1)
    rows = sorted(tuple(r) for r in top.collect())
    assert rows == [(1, "FOOD", "DAIRY", 2, "FOOD", "MEAT", 4), (2, "FOOD", "MEAT", 1, "FOOD", "DAIRY", 4)]
    assert "FOOD – DAIRY & FOOD – MEAT" in [r["pair"] for r in baskets.top_pair_labels(top).collect()]


def test_mirrored_pairs_have_equal_counts(three_pairs):
    counts = {(r["src"], r["dst"]): r["count"] for r in baskets.pair_edges(three_pairs).collect()}
    assert len(counts) == 6 and all(counts[b, a] == n for (a, b), n in counts.items())


def test_product_stats_and_pair_features(lines, products, households):
    frame = lines(
        [
            (1, 1, "2018-01-01", 1, "2.00", 2, "r"),
            (1, 1, "2018-01-01", 2, "6.00", 1, "r"),
            (2, 1, "2018-01-01", 1, "4.00", 1, "r"),
            (2, 2, "2018-01-01", 3, None, None, "r"),
            (2, 3, "2018-01-01", 3, "1.00", 1, "r"),
        ]
    )
    catalog = products([(1, "A", "x"), (2, "A", "y")])
    homes = households([(1, "Y", "a"), (2, "N", "a")])
    stats = baskets.product_stats(frame, catalog, homes)
    rows = {r["product_id"]: r for r in as_dicts(stats)}
    assert rows[1]["avg_spend"] == 3.0 and rows[1]["purchase_frequency"] == 2 / 4 and rows[1]["loyalty_ratio"] == 0.5
    assert rows[3]["department"] is None and rows[3]["avg_spend"] == 1.0 and rows[3]["purchase_count"] == 2
    features = as_dicts(baskets.pair_features(baskets.basket_pairs(frame), stats))
    assert len(features) == 1
    pair = features[0]
    assert pair["price_similarity"] == 1 - 3 / (9 + 0.001)
    assert (pair["same_department"], pair["normalized_count"], pair["total_frequency"]) == (1, 1.0, 0.75)
    bare = baskets.product_stats(frame, catalog.select("product_num"))
    assert baskets.pair_features(baskets.basket_pairs(frame), bare).first()["same_department"] == 0


def test_unknown_departments_are_not_the_same(spark, lines, products):
    frame = lines([(1, 1, "2018-01-01", p, 1, 1, "r") for p in (1, 2)])
    stats = baskets.product_stats(frame, products([]))
    assert baskets.pair_features(baskets.basket_pairs(frame), stats).first()["same_department"] == 0


def test_pair_lookup_in_either_order(spark, three_pairs):
    wanted = spark.createDataFrame([(2, 1), (2, 3), (8, 9)], "product1 bigint, product2 bigint")
    assert as_counts(baskets.pair_lookup(three_pairs, wanted)) == {(1, 2): 4, (2, 3): 2}
    strengths = {(r["product1"], r["product2"]): r["normalized_count"] for r in baskets.pair_strengths(three_pairs, wanted).collect()}
    assert strengths == {(1, 2): 1.0, (2, 3): 0.5}


def test_partitions_grow_with_the_lines(spark, lines, monkeypatch):
    """A task gets about so many rows, however many there are."""
    monkeypatch.setattr(baskets, "dealt_by_rows", partial(session.dealt_by_rows, task_rows=60))
    rng = random.Random(3)
    rows = [(basket % 50, basket, "2018-01-01", rng.randrange(40), 1, 1, "r") for basket in range(600) for _ in range(3)]
    frame = lines(rows)
    assert as_counts(baskets.basket_pairs(frame)) == brute_pairs(rows)
    least = len(rows) // 60
    assert baskets.basket_items(frame).rdd.getNumPartitions() == least
    assert baskets._paired(frame, baskets.BLOCK_PRODUCTS).rdd.getNumPartitions() >= least
    empty = lines([])
    assert baskets.basket_pairs(empty).isEmpty() and baskets.multi_item_baskets(empty).isEmpty()
