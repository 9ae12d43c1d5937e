"""Joins on keys that hold a large share of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from basketwise.operators import baskets, skew
from basketwise.schema import PRODUCTS
from basketwise.session import stage
from tests.conftest import as_dicts


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows have key 7, a tenth none."""
    pick = random.Random(3)
    keys = [7] * 3_000 + [None] * 900 + [pick.randrange(600) for _ in range(5_100)]
    pick.shuffle(keys)
    return spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key long, line long").repartition(8)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, f"name {k}") for k in range(0, 1000, 2)] + [(7, "seven"), (8, "twice")], "key long, name string")


def test_heavy_keys(spark, rows):
    assert [r.key for r in skew.heavy_keys(rows, ["key"]).collect()] == [7]
    assert skew.heavy_keys(spark.range(5_000), ["id"]) is None
    assert skew.heavy_keys(spark.range(0), ["id"]) is None


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("most", [300, 100_000, 0])
def test_same_rows_as_a_plain_join(rows, table, how, most):
    """Whether the table is sent whole, only its heavy keys' rows are, or nothing is."""
    found = skew.join_spread(rows, table, ["key"], how, broadcast_rows=most)
    plain = rows.join(table, ["key"], how)
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_two_keys(spark):
    left = spark.createDataFrame([(1, "a", k) for k in range(900)] + [(k, None, k) for k in range(90)], "x int, y string, n int")
    right = spark.createDataFrame([(1, "a", 5)] + [(k, "b", 6) for k in range(400)], "x int, y string, z int")
    found = skew.join_spread(left, right, ["x", "y"], broadcast_rows=300)
    assert sorted(map(str, found.collect())) == sorted(map(str, left.join(right, ["x", "y"], "left").collect()))


@pytest.fixture
def no_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def largest_task(frame):
    return frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_no_task_gets_all_rows_of_a_product(spark, lines, no_adaptive, monkeypatch):
    monkeypatch.setattr(skew, "fits_broadcast", lambda df, *limits: df.count() <= 300)
    sold = lines([(1, b, "2018-01-01", 7 if b % 3 == 0 else 1000 + b, 1, 1, "r") for b in range(3_000)]).repartition(8)
    products = spark.createDataFrame([(n, "d", "c", "PRIVATE", "N") for n in [7, *range(1000, 4000)]], PRODUCTS)
    assert largest_task(sold.join(products.hint("merge"), "product_num", "left")) > 1_000
    spread = baskets.enrich_lines(sold, products)
    assert spread.count() == 3_000 and spread.where("department = 'd'").count() == 3_000
    assert largest_task(spread) < 700


def test_pairs_below_the_floor_are_not_shuffled(spark, lines):
    pick = random.Random(5)
    rows = []
    for basket in range(400):
        bought = {pick.randrange(300) for _ in range(6)} | ({1, 2} if basket % 4 == 0 else set())
        rows += [(basket, basket, "2018-01-01", p, 1, 1, "r") for p in bought]
    pairs = baskets._paired(lines(rows), baskets.BLOCK_PRODUCTS)
    kept = baskets._possible_pairs(pairs, 20)
    assert kept.count() < 0.05 * pairs.count()
    assert baskets._counted(kept).where("count >= 20").collect() == baskets._counted(pairs).where("count >= 20").collect()
    direct, pruned = (as_dicts(baskets.top_pairs(lines(rows), 3, 10, direct_lines=most)) for most in (10**6, 0))
    assert direct == pruned and direct[0] == {"product1": 1, "product2": 2, "count": 100}


def test_lines_are_shuffled_once_for_pairs(spark, lines):
    frame = stage(lines([(1, b, "2018-01-01", p, 1, 1, "r") for b in range(2_000) for p in range(b % 5)]))
    pairs = baskets._paired(frame, 100)
    assert len(pairs.collect()) == 400 * (1 + 3 + 6)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    # Final and initial plan both show the one exchange that is not reused.
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("REPARTITION_BY_COL") - final.count("ReusedExchange") <= 1


def test_pairs_of_a_basket_are_met_without_a_join(spark, lines):
    """One reading of the shuffled lines gives the pairs, unless a basket may have too many products."""
    rows = [(1, b, "2018-01-01", p, 1, 1, "r") for b in range(2_000) for p in range(b % 5)]
    frame = stage(lines(rows))
    assert "Join" not in baskets._paired(frame, 100)._jdf.queryExecution().optimizedPlan().toString()
    wide = stage(lines([*rows, *[(1, 9_000, "2018-01-01", p, 1, 1, "r") for p in range(9)]]))
    assert sorted(baskets._paired(wide, 4).collect()) == sorted(baskets._paired(wide, 100).collect())
    assert baskets._paired(wide, 100).count() == 400 * (1 + 3 + 6) + 36
