from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import DateTimeException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise.functions import dates, labels, text
from basketwise.operators import columns, profile
from tests.conftest import as_dicts


def convert(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row["r"] for row in frame.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_two_digit_years(spark):
    values = ["17-Aug-18", "17-Aug-98", "01-Jan-69", "31-Dec-68", "null", "", None, "7-aug-18", "31-Feb-18", "17-08-18"]
    assert convert(spark, values, dates.parse_purchase_date) == [
        date(2018, 8, 17),
        date(1998, 8, 17),
        date(1969, 1, 1),
        date(2068, 12, 31),
        None,
        None,
        None,
        date(2018, 8, 7),
        None,
        None,
    ]


def test_any_date_takes_iso_too(spark):
    assert convert(spark, [" 2018-08-17 ", "17-Aug-18 ", "soon"], dates.parse_any_date) == [
        date(2018, 8, 17),
        date(2018, 8, 17),
        None,
    ]


def test_strict_date_raises(spark):
    with pytest.raises(DateTimeException):
        convert(spark, ["soon"], dates.to_date_strict)


def test_integers(spark):
    values = ["5", " 5 ", "5+", "null", None, "12.7", "-12.7", "3d", "inf", "NaN", "1e3", "99999999999", ".5", "5."]
    assert convert(spark, values, text.to_int_or_zero) == [5, 5, 0, 0, 0, 12, -12, 0, 0, 0, 1000, 0, 0, 5]
    assert convert(spark, values, text.to_int_or_null) == [
        5, 5, None, None, None, None, None, None, None, None, 1000, None, None, 5,
    ]


def test_numbers(spark):
    values = ["12.40", " 7.05", "n/a", None, "-1", "inf"]
    assert convert(spark, values, text.to_number_or_zero) == [
        Decimal(v) for v in ("12.40", "7.05", "0.00", "0.00", "-1.00", "0.00")
    ]


def test_long_keys_are_exact(spark):
    values = ["9007199254740993", "9223372036854775807", "9223372036854775808", "12.5", "x"]
    assert convert(spark, values, lambda c: text.as_long(text.number_text(c))) == [
        9007199254740993,
        9223372036854775807,
        None,
        None,
        None,
    ]


def test_null_words(spark):
    frame = spark.createDataFrame([("NULL  ",), (" Null",), (None,), ("   ",), (" x ",)], "v string")
    cleaned = columns.standardize_nulls(columns.trim_strings(frame))
    assert [row["v"] for row in cleaned.collect()] == ["null", "null", "null", "", "x"]


def test_right_trim_keeps_the_left(spark):
    frame = spark.createDataFrame([(" a ", 1)], "v string, n int")
    assert as_dicts(columns.trim_strings_right(frame)) == [{"v": " a", "n": 1}]


def test_column_names(spark):
    frame = spark.createDataFrame([(1, "a")], "` Hshd_num ` int, `L  ` string")
    assert columns.strip_columns(frame).columns == ["Hshd_num", "L"]
    assert columns.standardize_columns(frame).columns == ["HSHD_NUM", "L"]
    with pytest.raises(ValueError, match="PRODUCT_NUM"):
        columns.rename_to_model(columns.standardize_columns(frame), "products")


def test_column_choice(spark):
    frame = spark.createDataFrame([(1, 2.0, "a")], "dept_a int, p1_b double, c string")
    assert columns.columns_of_type(frame, T.StringType) == ["c"]
    assert columns.columns_of_type(frame, T.NumericType) == ["dept_a", "p1_b"]
    assert columns.columns_with_prefix(frame, "dept_", "p1_") == ["dept_a", "p1_b"]
    assert columns.has_columns(frame, ["c"]) and not columns.has_columns(frame, ["c", "d"])
    assert columns.concat_columns(frame, {"d": F.lit(1)}).columns == ["dept_a", "p1_b", "c", "d"]


def test_profile(spark):
    frame = spark.createDataFrame([(1, None), (2, "b"), (None, None)], "n int, `a b` string")
    assert [(r["column_name"], r["data_type"], r["non_null"]) for r in profile.profile(frame).collect()] == [
        ("n", "int", 2),
        ("a b", "string", 1),
    ]
    assert profile.head(frame, 2).count() == 2
    nan = spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "x double, s string")
    assert {r["column_name"]: r["has_null"] for r in profile.null_columns(nan).collect()} == {"x": True, "s": False}


def test_display_texts(spark):
    frame = spark.createDataFrame([(0.1234, Decimal("1234.50"), None)], "p double, m decimal(12,2), d string")
    row = frame.select(
        labels.percent(F.col("p")).alias("p"),
        labels.money(F.col("m")).alias("m"),
        labels.product(F.col("d"), F.lit("PET")).alias("l"),
        labels.loyalty(F.col("d")).alias("f"),
    ).first()
    assert tuple(row) == ("12.3%", "$1234.50", "null – PET", "Non-Loyal")


def test_white_space_of_every_kind_is_cut_and_blanks_cheaply(spark, capsys):
    """The result of a trim by the whole list, which only texts with another character than a blank at an end go through."""
    cases = [None, "", " ", "  a b ", "a", "\u3000 \t", "é \xa0"]
    cases += [f"{left}x{white}y{right}" for white in text.WHITE_SPACE for left, right in ((white, ""), ("", white), (f" {white} ", f"{white}  {white} "))]
    frame = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, value string").repartition(2)
    both = frame.select("n", "value", text.strip(F.col("value")).alias("cut"), text.strip_right(F.col("value")).alias("right"))
    for row in both.collect():
        value = row["value"]
        assert row["cut"] == (value and value.strip(text.WHITE_SPACE)) and row["right"] == (value and value.rstrip(text.WHITE_SPACE))
    both.explain()
    plan = capsys.readouterr().out
    assert plan.count("CASE WHEN") >= 2 and " INSET " in plan
