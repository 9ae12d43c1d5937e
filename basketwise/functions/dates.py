"""Purchase-date parsing and date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketwise.functions.text import strip

# Format of the extract's dates, and the first two-digit year that
# belongs to the 1900s.
PURCHASE_FORMAT, PURCHASE_SHAPE = "d-MMM-yy", "^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{2}$"
CENTURY_PIVOT = 69


def parse_purchase_date(column: Column) -> Column:
    """'17-Aug-18' to a date, bad text to null; years 69-99 lie in the 1900s.

    Only text of the right shape is parsed, as a failed parse is slow.
    """
    text = strip(column)
    parsed = F.try_to_date(F.when(text.rlike(PURCHASE_SHAPE), text), PURCHASE_FORMAT)
    return F.when(F.year(parsed) >= 2000 + CENTURY_PIVOT, F.add_months(parsed, -1200)).otherwise(parsed)


def parse_any_date(column: Column) -> Column:
    """The extract's format first, then ISO dates; bad text gives null."""
    return F.coalesce(parse_purchase_date(column), strip(column).try_cast("date"))


def to_date_strict(column: Column) -> Column:
    """ISO text to a date; bad text raises, as the session runs in ANSI mode."""
    return F.to_date(column)


def days_between(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier)
