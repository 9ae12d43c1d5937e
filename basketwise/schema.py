"""Schemas of the three tables and the header names of their CSV extracts."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
MONEY_TOTAL = T.DecimalType(38, 2)

TRANSACTIONS = T.StructType(
    [
        T.StructField("basket_num", T.LongType()),
        T.StructField("hshd_num", T.LongType()),
        T.StructField("purchase_date", T.DateType()),
        T.StructField("product_num", T.LongType()),
        T.StructField("spend", MONEY),
        T.StructField("units", T.IntegerType()),
        T.StructField("store_region", T.StringType()),
        T.StructField("week_num", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
    ]
)

HOUSEHOLDS = T.StructType(
    [
        T.StructField("hshd_num", T.LongType()),
        T.StructField("loyalty_flag", T.StringType()),
        T.StructField("age_range", T.StringType()),
        T.StructField("marital_status", T.StringType()),
        T.StructField("income_range", T.StringType()),
        T.StructField("homeowner_desc", T.StringType()),
        T.StructField("hshd_composition", T.StringType()),
        T.StructField("hshd_size", T.IntegerType()),
        T.StructField("children", T.IntegerType()),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_num", T.LongType()),
        T.StructField("department", T.StringType()),
        T.StructField("commodity", T.StringType()),
        T.StructField("brand_type", T.StringType()),
        T.StructField("natural_organic_flag", T.StringType()),
    ]
)

# The partition column of lines stored by purchase month.
MONTH = "purchase_month"

TABLES = {"transactions": TRANSACTIONS, "households": HOUSEHOLDS, "products": PRODUCTS}

# Header names of the CSV extracts and the columns they fill.
CSV_NAMES = {
    "transactions": {
        "BASKET_NUM": "basket_num",
        "HSHD_NUM": "hshd_num",
        "PURCHASE_": "purchase_date",
        "PRODUCT_NUM": "product_num",
        "SPEND": "spend",
        "UNITS": "units",
        "STORE_R": "store_region",
        "WEEK_NUM": "week_num",
        "YEAR": "year",
    },
    "households": {
        "HSHD_NUM": "hshd_num",
        "L": "loyalty_flag",
        "AGE_RANGE": "age_range",
        "MARITAL": "marital_status",
        "INCOME_RANGE": "income_range",
        "HOMEOWNER": "homeowner_desc",
        "HSHD_COMPOSITION": "hshd_composition",
        "HH_SIZE": "hshd_size",
        "CHILDREN": "children",
    },
    "products": {
        "PRODUCT_NUM": "product_num",
        "DEPARTMENT": "department",
        "COMMODITY": "commodity",
        "BRAND_TY": "brand_type",
        "NATURAL_ORGANIC_FLAG": "natural_organic_flag",
    },
}

# Columns a row must have to be loaded.
REQUIRED = {
    "transactions": ["basket_num", "hshd_num", "purchase_date", "product_num"],
    "households": ["hshd_num"],
    "products": ["product_num"],
}

DEMOGRAPHICS = [
    "age_range",
    "marital_status",
    "income_range",
    "homeowner_desc",
    "hshd_composition",
    "hshd_size",
    "children",
]
