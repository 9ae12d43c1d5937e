from decimal import Decimal

import pytest

from basketwise.operators import customers, dashboard
from basketwise.operators.dimension import sum_by_dimension
from pyspark.sql import functions as F
from tests.conftest import as_dicts


@pytest.fixture
def history(lines):
    return lines(
        [
            (1, 10, "2018-01-01", 100, "2.00", 1, "b"),
            (1, 10, "2018-01-01", 101, "4.00", 2, "a"),
            (1, 11, "2018-03-02", 100, "6.00", 1, "b"),
            (1, 12, "2018-03-02", 102, None, None, "a"),
            (1, None, "2018-03-02", 102, "1.00", 0, None),
            (2, 20, "2018-10-01", 100, "5.00", 1, "c"),
            (3, 30, "2018-10-01", 100, "5.00", 1, "c"),
            (3, 31, "2018-12-30", 100, "9.00", 3, "c"),
            (4, 40, "2018-12-30", 100, "7.00", 1, "c"),
            (None, 50, "2018-02-01", 100, "7.00", 1, "c"),
            (5, 60, None, 100, "7.00", 1, "c"),
        ]
    )


def test_cutoff_is_ninety_days_before_the_last_day(history):
    row = customers.cutoff(history).first()
    assert (str(row["latest_date"]), str(row["cutoff_date"])) == ("2018-12-30", "2018-10-01")


def test_features(history):
    rows = {r["hshd_num"]: r for r in as_dicts(customers.customer_features(history))}
    assert sorted(rows) == [1, 2, 3]
    one = rows[1]
    assert one["purchase_count"] == 3 and one["unique_products"] == 3
    assert one["total_spend"] == Decimal("13.00") and one["total_units"] == 4
    assert one["avg_basket_value"] == 13 / 4  # the line without a basket number counts as one
    assert one["store_region"] == "a"  # two each, the smaller name wins
    assert (one["tenure"], one["tenure_safe"]) == (60, 60)
    assert one["purchase_frequency"] == 3 / (60 / 30)
    assert one["spend_per_visit"] == 13 / 3
    two = rows[2]
    assert (two["tenure"], two["tenure_safe"], two["purchase_frequency"]) == (0, 1, 30.0)


def test_churn(history, households):
    homes = households([(1, "Y", "45-54"), (3, "N", "65+")])
    rows = {r["hshd_num"]: r for r in as_dicts(customers.churn_features(history, homes))}
    assert {n: r["churned"] for n, r in rows.items()} == {1: 1, 2: 1, 3: 0}
    assert rows[1]["age_range"] == "45-54" and rows[2]["age_range"] is None
    assert rows[1]["product_diversity_ratio"] == 3 / 4
    labels = {r["hshd_num"]: r["churned"] for r in customers.churn_label(history).collect()}
    assert labels == {1: 1, 2: 1, 3: 0}
    assert sorted(r["hshd_num"] for r in customers.churned_households(history).collect()) == [1, 2]
    assert [r["hshd_num"] for r in customers.retained_households(history).collect()] == [3]
    assert customers.churn_rate(customers.churn_label(history)).first()["churn_rate"] == 2 / 3


def test_demographics_are_optional(history):
    assert "age_range" not in customers.churn_features(history).columns


def test_clv(history, products):
    catalog = products([(100, "Non Food", "PET"), (101, "NON FOOD", "PET"), (102, None, None), (103, "Unsold", "X")])
    frame = customers.clv_features(history, catalog)
    assert customers.department_features(frame) == ["dept_non_food"]
    rows = {r["hshd_num"]: r for r in as_dicts(frame)}
    assert rows[1]["dept_non_food"] == Decimal("12.00")
    assert (rows[1]["recency"], rows[2]["recency"]) == (213, 0)
    assert rows[1]["future_spend"] == 0 and rows[3]["future_spend"] == Decimal("9.00")
    three = rows[3]
    share = 1 / 365
    blended = share * (5 / (1 / 30)) + (1 - share) * (9 / 3)
    assert three["annual_clv"] == 36.0
    assert three["clv_12_month"] == pytest.approx(blended * 12)
    summary = customers.clv_summary(frame.select("clv_12_month")).first()
    values = sorted(r["clv_12_month"] for r in rows.values())
    assert summary["median_clv"] == values[1] and summary["max_clv"] == values[2]


def test_too_many_departments_raise(history, products):
    catalog = products([(100, "A", "x"), (101, "B", "x"), (102, "C", "x")])
    with pytest.raises(ValueError, match="departments"):
        customers.category_pivot(history, catalog, limit=2)
    assert len(customers.category_pivot(history, catalog, limit=None).columns) == 4
    maps = {r["hshd_num"]: r["department_spend"] for r in customers.category_map(history, catalog).collect()}
    wide = {r["hshd_num"]: r.asDict() for r in customers.category_pivot(history, catalog).collect()}
    assert {h: {c: m.get(c, 0) for c in ("dept_a", "dept_b", "dept_c")} for h, m in maps.items()} == {
        h: {c: r[c] for c in ("dept_a", "dept_b", "dept_c")} for h, r in wide.items()
    }


def test_large_and_small_dimensions_agree(history, households, products):
    """The broadcast way and the summed-before-the-join way give the same rows."""
    homes = households([(1, "Y", None), (2, "N", "65+"), (3, "N", "65+"), (4, None, "19-24")])
    catalog = products([(100, "A", "x"), (101, "B", None), (102, None, "x")])
    for report, dimension in (
        (dashboard.demographics_engagement, homes),
        (dashboard.loyalty_mix, homes),
        (dashboard.top_commodities, catalog),
        (dashboard.commodity_units_spend, catalog),
    ):
        small = report(history, dimension).collect()
        large = report(history, dimension, broadcast_rows=1).collect()
        assert sorted(map(str, small)) == sorted(map(str, large)) and small
    both = [
        sum_by_dimension(history, homes, "hshd_num", ["hshd_num", "age_range"], {"n": F.lit(1)}, broadcast_rows=n)
        for n in (1, 100)
    ]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))


def test_null_groups_are_kept(history, households):
    homes = households([(1, None, None)])
    assert dashboard.loyalty_mix(history, homes).first().asDict() == {
        "loyalty_flag": None,
        "count": 5,
        "label": "Non-Loyal",
    }


def test_household_lines_are_ordered(history, products):
    catalog = products([(100, "A", "x"), (101, "B", "x"), (102, "C", "x")])
    rows = dashboard.household_lines(history, catalog, 1).collect()
    assert [(r["basket_num"], r["product_num"]) for r in rows] == [(None, 102), (10, 100), (10, 101), (11, 100), (12, 102)]
    with pytest.raises(ValueError):
        dashboard.household_lines(history, catalog, "1 OR 1=1")


def test_limits(history, products):
    catalog = products([(100, "A", "x"), (101, "B", "y"), (102, "C", "z")])
    assert dashboard.commodity_units_spend(history, catalog, limit=1).first()["commodity"] == "x"
    assert [r["commodity"] for r in dashboard.top_commodities(history, catalog, 2).collect()] == ["x", "z"]
