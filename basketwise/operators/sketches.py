"""Distinct counts that can be merged: baskets and products of a household in any months.

Counts of distinct values cannot be added up. A HyperLogLog sketch for each household and
month can be merged, so that a count over any span of months reads the stored sketches
and no lines. The counts are estimates; exact ones stay the default of `customers`.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 2^PRECISION registers: a standard error of 1.04 / sqrt(2^PRECISION), 1.6 % for 12.
PRECISION = 12


def monthly_sketches(lines: DataFrame, precision: int = PRECISION) -> DataFrame:
    """(hshd_num, month, lines, baskets, products): sketches of one month of a household, to be stored.

    Months are those of the purchase date. Lines without a household or date are left out,
    and nulls are counted nowhere. Sketches are combined before their shuffle.
    """
    month = F.trunc("purchase_date", "month").alias("month")
    known = lines.where(F.col("hshd_num").isNotNull() & F.col("purchase_date").isNotNull())
    return known.groupBy("hshd_num", month).agg(
        F.count(F.lit(1)).alias("lines"),
        F.hll_sketch_agg("basket_num", F.lit(precision)).alias("baskets"),
        F.hll_sketch_agg("product_num", F.lit(precision)).alias("products"),
    )


def merged_counts(sketches: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """(hshd_num, lines, baskets, products) over the months from `first` to `last`, both included; estimates but for lines."""
    chosen = sketches
    if first is not None:
        chosen = chosen.where(F.col("month") >= F.trunc(F.lit(first), "month"))
    if last is not None:
        chosen = chosen.where(F.col("month") <= F.trunc(F.lit(last), "month"))
    return chosen.groupBy("hshd_num").agg(
        F.sum("lines").alias("lines"),
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("baskets", "products")],
    )
