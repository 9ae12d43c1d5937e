"""Properties of physical plans that matter at scale."""

import contextlib
import io
import os

import pytest

from basketwise.operators import baskets, customers, dashboard
from basketwise.session import STAGED, drop_staged, ensure_checkpoint_dir, spread, stage
from basketwise.sinks import write_by_household, write_by_month
from basketwise.sources import star
from basketwise.sources.tables import read_by_month, register_by_household
from tests.conftest import DATA


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    return stage(star.transactions(spark, DATA))


def test_no_cross_joins(spark, stored):
    products, households = star.products(spark, DATA), star.households(spark, DATA)
    pairs = baskets.basket_pairs(stored)
    for frame in (
        customers.clv_features(stored, products, households),
        customers.churn_features(stored, households),
        customers.churned_households(stored),
        dashboard.demographics_engagement(stored, households),
        dashboard.demographics_engagement(stored, households, broadcast_rows=1),
        pairs,
        baskets.pair_features(pairs, baskets.product_stats(stored, products, households)),
        baskets.product_stats(stored, products),
    ):
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_python_runs_nowhere(spark, stored):
    plan = plan_of(customers.clv_features(stored, star.products(spark, DATA), star.households(spark, DATA)))
    assert "Python" not in plan and "Pandas" not in plan


def test_household_filter_reaches_the_scan(spark, stored):
    plan = plan_of(dashboard.household_lines(stored, star.products(spark, DATA), 10))
    assert "EqualTo(hshd_num,10)" in plan


def test_cutoff_reaches_the_scan(stored):
    training, _ = customers.split_period(stored)
    assert "LessThanOrEqual(purchase_date,ScalarSubquery" in plan_of(training.select("hshd_num"))


def test_only_needed_columns_are_read(spark, stored):
    plan = plan_of(dashboard.seasonal_spend(stored))
    assert "ReadSchema: struct<purchase_date:date,spend:decimal(12,2)>" in plan
    assert "orders" not in plan_of(star.transactions(spark, DATA, ["product_num", "spend"]))


def test_totals_are_combined_before_the_shuffle(stored):
    plan = plan_of(dashboard.spend_over_time(stored))
    assert "partial_sum" in plan


def test_lines_stored_by_household_are_not_shuffled_by_household(spark, stored, tmp_path):
    """At most three scans beside those of the cutoff, and no exchange, for all features."""
    table = write_by_household(stored, "bucketed_lines", f"{tmp_path}/lines", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        features = customers.customer_features(table)
        main, *subqueries = plan_of(features).split("===== Subqueries =====")[0].split("== Physical Plan ==")[1].split("\n\n")
        assert "Exchange" not in main and main.count("Scan parquet") <= 3
        again = register_by_household(spark.newSession(), "other_name", f"{tmp_path}/lines", 8)
        assert sorted(map(str, customers.customer_features(again).collect())) == sorted(map(str, customers.customer_features(stored).collect()))
        assert "Exchange" not in plan_of(again.groupBy("hshd_num").count())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_lines")


def test_months_outside_a_window_are_not_read(spark, stored, tmp_path):
    write_by_month(stored, f"{tmp_path}/lines")
    lines = read_by_month(spark, f"{tmp_path}/lines")
    months = lines.select("purchase_month").distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        read = []
        for window, plain in zip(customers.split_period(lines), customers.split_period(stored)):
            assert window.columns == plain.columns
            assert window.count() == plain.count()
            rows = window.select("hshd_num")
            rows.collect()
            scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
            read.append(scan.metrics().apply("numPartitions").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # The month of the cutoff is in both.
    assert sum(read) == months + 1 and read[1] <= 5 < read[0]


def test_spread_leaves_wide_scans_alone(spark, stored):
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_checkpoint_folder_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_staged_copies_can_be_dropped(spark):
    other = spark.newSession()
    copy = stage(other.range(10))
    path = STAGED[other][0].removeprefix("file:")
    assert copy.count() == 10 and os.path.isdir(path)
    assert drop_staged(other) == 1 and not os.path.exists(path)
    assert drop_staged(other) == 0
