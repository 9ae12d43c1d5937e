"""Trimming, null words and text-to-number conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The text that stands for a missing string, and the number format.
NULL_WORD = "null"
NUMBER_FORMAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(column: Column) -> Column:
    """Cut white space of any kind at both ends.

    Blanks are cut first: to look for a list of characters takes many times as long, and
    few texts have another one at an end.
    """
    plain = F.trim(column)
    return F.when(_white(plain, 1) | _white(plain, -1), F.trim(plain, F.lit(WHITE_SPACE))).otherwise(plain)


def strip_right(column: Column) -> Column:
    """Cut white space of any kind at the right end, blanks first as in `strip`."""
    plain = F.rtrim(column)
    return F.when(_white(plain, -1), F.rtrim(plain, F.lit(WHITE_SPACE))).otherwise(plain)


def _white(text: Column, place: int) -> Column:
    """Whether the character there is white space."""
    return F.substring(text, place, 1).isin(*WHITE_SPACE)


def null_word(column: Column) -> Column:
    """Null, and the word null in any case, become the text 'null'."""
    return F.when(F.lower(column) == NULL_WORD, F.lit(NULL_WORD)).otherwise(F.coalesce(column, F.lit(NULL_WORD)))


def number_text(text: Column) -> Column:
    """The text, already stripped, where it is a plain number, else null.

    The format test comes first because a bare cast also takes 'inf', 'NaN' and
    the type-suffixed '3d'.
    """
    return F.when(text.rlike(NUMBER_FORMAT), text)


def as_int(number: Column) -> Column:
    """Number text to 32 bits, fractions cut towards zero; null beyond the range."""
    return number.try_cast("double").try_cast("int")


def as_long(number: Column) -> Column:
    """Whole-number text to 64 bits, exact over all of them; null for fractions."""
    exact = number.try_cast("decimal(38,6)")
    return F.when(exact == F.floor(exact), exact.try_cast("bigint"))


def to_int_or_null(column: Column) -> Column:
    """Whole numbers only: 32.5, text and values beyond 32 bits give null."""
    number = number_text(strip(column)).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def to_int_or_zero(column: Column) -> Column:
    """Fractions are cut towards zero; what is no number gives 0."""
    return F.coalesce(as_int(number_text(strip(column))), F.lit(0))


def to_number_or_zero(column: Column, kind: str = "decimal(12,2)") -> Column:
    return F.coalesce(number_text(strip(column)).try_cast(kind), F.lit(0).cast(kind))
