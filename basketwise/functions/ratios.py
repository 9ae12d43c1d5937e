"""Per-customer and per-pair arithmetic; counts and money come in, doubles go out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of the periods, in days and months.
DAYS_PER_MONTH = 30
DAYS_PER_YEAR = 365
WINDOW_MONTHS = 3
WINDOWS_PER_YEAR = 4
MONTHS_PER_YEAR = 12
PRICE_GUARD = 0.001


def real(column: Column) -> Column:
    return column.cast("double")


def at_least_one(column: Column) -> Column:
    return F.greatest(column, F.lit(1))


def per_month(amount: Column, days: Column) -> Column:
    return real(amount) / (real(days) / F.lit(float(DAYS_PER_MONTH)))


def ratio(amount: Column, base: Column) -> Column:
    """`amount` over `base`, the base counted as one where it is below one."""
    return real(amount) / real(at_least_one(base))


def confidence(days: Column) -> Column:
    """Share of a year the customer has been seen, at most one."""
    return F.least(real(days) / F.lit(float(DAYS_PER_YEAR)), F.lit(1.0))


def price_similarity(price1: Column, price2: Column) -> Column:
    return F.lit(1.0) - F.try_divide(F.abs(price1 - price2), price1 + price2 + F.lit(PRICE_GUARD))


def same(first: Column, second: Column) -> Column:
    """1 where both are known and equal, else 0."""
    return F.coalesce((first == second).cast("int"), F.lit(0))


def finite_or_null(column: Column) -> Column:
    """Infinite and NaN values become null."""
    number = real(column)
    return F.when(F.abs(number) < F.lit(float("inf")), number)
