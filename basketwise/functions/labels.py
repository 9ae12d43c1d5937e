"""Display labels of charts, lists and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts shown by the reports.
DASH = " – "
AMPERSAND = " & "
LOYAL, NOT_LOYAL = "Loyal", "Non-Loyal"
UNKNOWN = "Unknown"


def shown(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("null"))


def region_age(region: Column, age: Column) -> Column:
    return F.concat_ws(", ", shown(region), shown(age))


def year_month(year: Column, month: Column) -> Column:
    return F.concat_ws("-", shown(year), shown(month))


def month_name(month: Column) -> Column:
    return F.concat(F.lit("Month "), shown(month))


def loyalty(flag: Column) -> Column:
    """'Y' is loyal; every other value, null too, is not."""
    return F.when(flag == "Y", F.lit(LOYAL)).otherwise(F.lit(NOT_LOYAL))


def product(department: Column, commodity: Column) -> Column:
    return F.concat_ws(DASH, shown(department), shown(commodity))


def product_pair(department1: Column, commodity1: Column, department2: Column, commodity2: Column) -> Column:
    return F.concat_ws(AMPERSAND, product(department1, commodity1), product(department2, commodity2))


def value_range(low: Column, high: Column) -> Column:
    """Both ends cut to whole numbers."""
    return F.concat_ws("-", low.cast("bigint").cast("string"), high.cast("bigint").cast("string"))


def percent(share: Column) -> Column:
    """One decimal, with the sign; for display only."""
    return F.concat(F.format_number(share * 100, 1), F.lit("%"))


def money(amount: Column) -> Column:
    """Two decimals without grouping; for display only."""
    return F.format_string("$%.2f", amount.cast("double"))
