"""Household lookup and the six dashboard aggregates.

Null group keys are kept, as a SQL GROUP BY does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.functions import labels
from basketwise.functions.ratios import real
from basketwise.operators.dimension import sum_by_dimension
from basketwise.schema import MONEY_TOTAL



def _present(name: str) -> Column:
    return F.col(name).isNotNull().cast("bigint")


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _money(total: str) -> Column:
    return F.col(total).cast(MONEY_TOTAL).alias(total)


def household_lines(transactions: DataFrame, products: DataFrame, hshd_num: int = 10) -> DataFrame:
    """All lines of one household with their product's department and commodity."""
    lines = transactions.where(F.col("hshd_num") == F.lit(int(hshd_num)))
    return (
        lines.join(products, "product_num")
        .select(
            "hshd_num",
            "basket_num",
            "purchase_date",
            "product_num",
            "department",
            "commodity",
            "spend",
            "units",
            "store_region",
            "week_num",
            "year",
        )
        .orderBy("hshd_num", "basket_num", "purchase_date", "product_num")
    )


def demographics_engagement(transactions: DataFrame, households: DataFrame, **options) -> DataFrame:
    """Average spend and units of a line by store region and age range."""
    sums = sum_by_dimension(
        transactions,
        households,
        "hshd_num",
        ["store_region", "age_range"],
        {
            "spend": F.col("spend"),
            "spend_lines": _present("spend"),
            "units": F.col("units").cast("bigint"),
            "units_lines": _present("units"),
        },
        **options,
    )
    return sums.select(
        "store_region",
        "age_range",
        F.try_divide(real(F.col("spend")), real(F.col("spend_lines"))).alias("avg_spend"),
        F.try_divide(real(F.col("units")), real(F.col("units_lines"))).alias("avg_units"),
        labels.region_age(F.col("store_region"), F.col("age_range")).alias("label"),
    )


def spend_over_time(transactions: DataFrame) -> DataFrame:
    """Total spend by stored year and by month of the purchase date."""
    return (
        transactions.groupBy("year", F.month("purchase_date").alias("month"))
        .agg(F.sum("spend").cast(MONEY_TOTAL).alias("total_spend"))
        .withColumn("label", labels.year_month(F.col("year"), F.col("month")))
        .orderBy("year", "month")
    )


def top_commodities(transactions: DataFrame, products: DataFrame, n: int = 5, **options) -> DataFrame:
    """The commodities with the most lines; equal counts in order of name."""
    counts = sum_by_dimension(transactions, products, "product_num", ["commodity"], {"count": _one()}, **options)
    return counts.orderBy(F.desc("count"), "commodity").limit(n)


def seasonal_spend(transactions: DataFrame) -> DataFrame:
    """Total spend by calendar month over all years."""
    return (
        transactions.groupBy(F.month("purchase_date").alias("month"))
        .agg(F.sum("spend").cast(MONEY_TOTAL).alias("total_spend"))
        .withColumn("label", labels.month_name(F.col("month")))
        .orderBy("month")
    )


def loyalty_mix(transactions: DataFrame, households: DataFrame, **options) -> DataFrame:
    """Number of lines by loyalty flag of the household."""
    counts = sum_by_dimension(transactions, households, "hshd_num", ["loyalty_flag"], {"count": _one()}, **options)
    return counts.withColumn("label", labels.loyalty(F.col("loyalty_flag")))


def commodity_units_spend(
    transactions: DataFrame, products: DataFrame, limit: int | None = None, **options
) -> DataFrame:
    """Units and spend by commodity, the largest spend first."""
    sums = sum_by_dimension(
        transactions,
        products,
        "product_num",
        ["commodity"],
        {"total_units": F.col("units").cast("bigint"), "total_spend": F.col("spend")},
        **options,
    )
    ranked = sums.select("commodity", "total_units", _money("total_spend")).orderBy(F.desc("total_spend"), "commodity")
    return ranked if limit is None else ranked.limit(limit)
