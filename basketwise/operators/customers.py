"""Customer features, churn labels and twelve-month value targets.

A household's training window ends at the cutoff, the evaluation window follows
it. Both windows are summed in one conditional aggregation, so churn and future
spend need no scan of their own. Lines without a household are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.functions import ratios
from basketwise.functions.dates import days_between
from basketwise.operators.columns import columns_with_prefix, dept_column
from basketwise.operators.dimension import sum_by_dimension
from basketwise.operators.ranking import exact_quantiles
from basketwise.schema import MONEY_TOTAL, MONTH
from basketwise.session import stage

WINDOW_DAYS = 90
MAX_DEPARTMENTS = 2_000

BASE_COLUMNS = [
    "hshd_num",
    "last_purchase_date",
    "first_purchase_date",
    "purchase_count",
    "total_spend",
    "total_units",
    "avg_basket_value",
    "unique_products",
    "store_region",
    "tenure",
    "tenure_safe",
    "purchase_frequency",
    "spend_per_visit",
]


def cutoff(transactions: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """One row: the latest purchase date and the last day of the training window."""
    return transactions.agg(F.max("purchase_date").alias("latest_date")).select(
        "latest_date", F.date_sub("latest_date", days).alias("cutoff_date")
    )


def _cutoff_date(transactions: DataFrame, days: int) -> Column:
    return cutoff(transactions, days).select("cutoff_date").scalar()


def split_period(transactions: DataFrame, days: int = WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """Lines up to the cutoff, cutoff included, and lines after it.

    Of lines stored by month, the months outside a window are not read: the cutoff is
    known before the scan starts.
    """
    last_day = _cutoff_date(transactions, days)
    date = F.col("purchase_date")
    if MONTH not in transactions.columns:
        return transactions.where(date <= last_day), transactions.where(date > last_day)
    last_month = cutoff(transactions, days).select(F.trunc("cutoff_date", "month")).scalar()
    lines = transactions.where(F.col(MONTH) <= last_month).drop(MONTH), transactions.where(F.col(MONTH) >= last_month).drop(MONTH)
    return lines[0].where(date <= last_day), lines[1].where(date > last_day)


def _household_totals(transactions: DataFrame, days: int) -> DataFrame:
    """One row per household with training lines: sums of both windows.

    Lines are summed per basket and baskets per household, and products are made
    distinct on their own. A count of distinct baskets and products in one go would
    carry all sums through the shuffle of the products as well.
    """
    last_day = _cutoff_date(transactions, days)
    lines = transactions.where(F.col("hshd_num").isNotNull()).withColumn(
        "in_training", F.col("purchase_date") <= last_day
    )
    training, evaluation = F.col("in_training"), ~F.col("in_training")

    def seen(name: str) -> Column:
        return F.when(training, F.col(name))

    per_basket = lines.groupBy("hshd_num", "basket_num").agg(
        F.max(seen("purchase_date")).alias("last_date"),
        F.min(seen("purchase_date")).alias("first_date"),
        F.sum(seen("spend")).alias("spend"),
        F.sum(seen("units").cast("bigint")).alias("units"),
        F.count_if(training).alias("training_lines"),
        F.count_if(evaluation).alias("evaluation_lines"),
        F.sum(F.when(evaluation, F.col("spend"))).alias("later_spend"),
    )
    numbered = F.col("basket_num").isNotNull()
    totals = (
        per_basket.groupBy("hshd_num")
        .agg(
            F.max("last_date").alias("last_purchase_date"),
            F.min("first_date").alias("first_purchase_date"),
            F.count_if(numbered & (F.col("training_lines") > 0)).alias("purchase_count"),
            F.sum(F.when(numbered, F.lit(0)).otherwise(F.col("training_lines"))).alias("loose_lines"),
            F.coalesce(F.sum("spend"), F.lit(0)).cast(MONEY_TOTAL).alias("total_spend"),
            F.coalesce(F.sum("units"), F.lit(0)).alias("total_units"),
            F.sum("training_lines").alias("training_lines"),
            F.sum("evaluation_lines").alias("evaluation_lines"),
            F.coalesce(F.sum("later_spend"), F.lit(0)).cast(MONEY_TOTAL).alias("future_spend"),
        )
        .where(F.col("training_lines") > 0)
    )
    bought = transactions.where(F.col("purchase_date") <= last_day)
    return totals.join(product_variety(bought), "hshd_num", "left").withColumn(
        "unique_products", F.coalesce(F.col("unique_products"), F.lit(0).cast("bigint"))
    )


def product_variety(lines: DataFrame) -> DataFrame:
    """Number of distinct products per household."""
    known = lines.where(F.col("hshd_num").isNotNull() & F.col("product_num").isNotNull())
    return (
        known.select("hshd_num", "product_num")
        .distinct()
        .groupBy("hshd_num")
        .agg(F.count(F.lit(1)).alias("unique_products"))
    )


def favourite_region(lines: DataFrame) -> DataFrame:
    """Most frequent store region per household; nulls ignored, ties to the smallest name.

    Counted per household and region first, so that a household with very many
    lines arrives as a few rows.
    """
    counts = (
        lines.where(F.col("hshd_num").isNotNull() & F.col("store_region").isNotNull())
        .groupBy("hshd_num", "store_region")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    first = F.min(F.struct((-F.col("lines")).alias("rank"), F.col("store_region").alias("name")))
    return counts.groupBy("hshd_num").agg(first.alias("first")).select("hshd_num", F.col("first.name").alias("store_region"))


def _with_base_features(transactions: DataFrame, days: int) -> DataFrame:
    training, _ = split_period(transactions, days)
    totals = _household_totals(transactions, days).join(favourite_region(training), "hshd_num", "left")
    spend, visits = F.col("total_spend"), F.col("purchase_count")
    return (
        totals.withColumn("tenure", days_between(F.col("first_purchase_date"), F.col("last_purchase_date")))
        .withColumn("tenure_safe", ratios.at_least_one(F.col("tenure")))
        .withColumns(
            {
                # Every line without a basket number counts as a basket of its own here.
                "avg_basket_value": ratios.real(spend) / ratios.real(visits + F.col("loose_lines")),
                "purchase_frequency": ratios.per_month(visits, F.col("tenure_safe")),
                "spend_per_visit": ratios.ratio(spend, visits),
            }
        )
    )


def customer_features(transactions: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Features shared by the churn and the value model, one row per training household."""
    return _with_base_features(transactions, days).select(*BASE_COLUMNS)


def households_seen(lines: DataFrame) -> DataFrame:
    """Distinct household numbers of some lines."""
    return lines.where(F.col("hshd_num").isNotNull()).select("hshd_num").distinct()


def churned_households(transactions: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Households seen in training but not in evaluation, as a set difference."""
    training, evaluation = split_period(transactions, days)
    return households_seen(training).join(households_seen(evaluation), "hshd_num", "left_anti")


def retained_households(transactions: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Households seen in training and in evaluation."""
    training, evaluation = split_period(transactions, days)
    return households_seen(training).join(households_seen(evaluation), "hshd_num", "left_semi")


def churn_label(transactions: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """1 for training households without a purchase after the cutoff, else 0."""
    date = F.col("purchase_date")
    # One row per household, stored, so that the lines are read once.
    spans = stage(transactions.groupBy("hshd_num").agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen")))
    last_day = _cutoff_date(spans.select(F.col("last_seen").alias("purchase_date")), days)
    return (
        spans.where(F.col("hshd_num").isNotNull())
        .where(F.col("first_seen") <= last_day)
        .select("hshd_num", (F.col("last_seen") <= last_day).cast("int").alias("churned"))
    )


def _churned() -> Column:
    return (F.col("evaluation_lines") == 0).cast("int")


def churn_features(transactions: DataFrame, households: DataFrame | None = None, days: int = WINDOW_DAYS) -> DataFrame:
    """Shared features, product diversity, demographics when given, and the churn label."""
    features = _with_base_features(transactions, days).select(
        *BASE_COLUMNS,
        ratios.ratio(F.col("unique_products"), F.col("total_units")).alias("product_diversity_ratio"),
        _churned().alias("churned"),
    )
    if households is not None:
        features = features.join(households, "hshd_num", "left")
    return features.select(*[c for c in features.columns if c != "churned"], "churned")


def churn_rate(features: DataFrame) -> DataFrame:
    """One row: the share of churned households."""
    return features.agg(
        F.try_divide(F.sum("churned").cast("double"), F.count("churned").cast("double")).alias("churn_rate")
    )


def category_spend(lines: DataFrame, products: DataFrame, **options) -> DataFrame:
    """Spend per household and department; lines of unknown department are left out."""
    known = products.where(F.col("department").isNotNull())
    named = lines.where(F.col("hshd_num").isNotNull())
    sums = sum_by_dimension(
        named, known, "product_num", ["hshd_num", "department"], {"category_spend": F.col("spend")}, **options
    )
    return sums.select(
        "hshd_num", "department", F.coalesce(F.col("category_spend"), F.lit(0)).cast(MONEY_TOTAL).alias("category_spend")
    )


def _department_names(spend: DataFrame, limit: int | None) -> list[str]:
    found = spend.select("column").distinct()
    names = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(names) > limit:
        raise ValueError(f"more than {limit} departments; pass the ones to keep, or use category_map")
    return sorted(row["column"] for row in names)


def category_pivot(
    lines: DataFrame,
    products: DataFrame,
    columns: Sequence[str] | None = None,
    limit: int | None = MAX_DEPARTMENTS,
    **options,
) -> DataFrame:
    """Department spend as one column per department, 0 where none was bought.

    Departments are grouped by their column name, so names that differ only in
    case or blanks share one column. Without `columns` the names are those that occur in
    the lines, which are summed once and stored; more than `limit` of them raise, as
    each becomes a column. `category_map` has no such bound.
    """
    spend = category_spend(lines, products, **options).withColumn("column", dept_column(F.col("department")))
    if columns is None:
        spend = stage(spend)
        columns = _department_names(spend, limit)
    columns = list(columns)
    pivot = spend.groupBy("hshd_num").pivot("column", columns).agg(F.sum("category_spend"))
    return pivot.select(
        "hshd_num", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast(MONEY_TOTAL).alias(c) for c in columns]
    )


def category_map(lines: DataFrame, products: DataFrame, **options) -> DataFrame:
    """(hshd_num, department_spend): the pivot as one map from feature name to spend, for any number of departments.

    A household's map holds the departments it bought in; others are absent, not 0.
    """
    spend = category_spend(lines, products, **options).withColumn("column", dept_column(F.col("department")))
    named = spend.groupBy("hshd_num", "column").agg(F.sum("category_spend").cast(MONEY_TOTAL).alias("spend"))
    entries = F.sort_array(F.collect_list(F.struct("column", "spend")))
    return named.groupBy("hshd_num").agg(F.map_from_entries(entries).alias("department_spend"))


def future_spend(transactions: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Spend per household after the cutoff."""
    _, evaluation = split_period(transactions, days)
    return (
        evaluation.where(F.col("hshd_num").isNotNull())
        .groupBy("hshd_num")
        .agg(F.coalesce(F.sum("spend"), F.lit(0)).cast(MONEY_TOTAL).alias("future_spend"))
    )


def clv_features(
    transactions: DataFrame,
    products: DataFrame,
    households: DataFrame | None = None,
    days: int = WINDOW_DAYS,
    departments: Sequence[str] | None = None,
) -> DataFrame:
    """Shared features, recency, department spend, demographics and the value target.

    The target mixes the spend seen so far into the projection, as far as the
    household's tenure supports it; it therefore contains total_spend and tenure.
    """
    last_day = _cutoff_date(transactions, days)
    training, _ = split_period(transactions, days)
    spend, future, tenure = F.col("total_spend"), F.col("future_spend"), F.col("tenure_safe")
    features = _with_base_features(transactions, days).select(
        *BASE_COLUMNS,
        days_between(F.col("last_purchase_date"), last_day).alias("recency"),
        (ratios.real(spend) / ratios.real(tenure)).alias("spend_per_day"),
        ratios.ratio(F.col("unique_products"), F.col("total_units")).alias("product_diversity"),
        "future_spend",
    )
    features = features.join(category_pivot(training, products, departments), "hshd_num", "left")
    if households is not None:
        features = features.join(households, "hshd_num", "left")
    share = ratios.confidence(tenure)
    monthly_future = ratios.real(future) / F.lit(float(ratios.WINDOW_MONTHS))
    blended = share * ratios.per_month(spend, tenure) + (F.lit(1.0) - share) * monthly_future
    return (
        features.withColumn("annual_clv", ratios.real(future) * F.lit(float(ratios.WINDOWS_PER_YEAR)))
        .withColumn("blended_monthly_spend", blended)
        .withColumn("clv_12_month", F.col("blended_monthly_spend") * F.lit(float(ratios.MONTHS_PER_YEAR)))
    )


def clv_summary(features: DataFrame, value: str = "clv_12_month") -> DataFrame:
    """One row: mean, exact median and maximum of the value."""
    median = exact_quantiles(features, value, [0.5])["q"][0]
    return features.agg(
        F.avg(value).alias("mean_clv"), F.lit(median).cast("double").alias("median_clv"), F.max(value).alias("max_clv")
    )


def department_features(features: DataFrame) -> list[str]:
    return columns_with_prefix(features, "dept_")
