"""The three retail tables as views on an order star schema.

Lines of orders become transactions, customers become households and parts become
products. Household attributes the star schema lacks are derived from its columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketwise.schema import MONEY, TRANSACTIONS
from basketwise.session import fits_broadcast, spread

ALL_COLUMNS = tuple(TRANSACTIONS.names)
FROM_ORDERS = {"hshd_num", "purchase_date", "week_num", "year"}

# Fixed values of the views.
AGE_RANGES = ["19-24", "25-34", "35-44", "45-54", "55-64", "65+"]
MARITAL = ["Married", "Single", "null"]
INCOME_STEPS = [(0, "UNDER 35K"), (3500, "35-49K"), (7000, "50-74K")]
TOP_INCOME = "75-99K"


@lru_cache(maxsize=None)
def _schema(spark: SparkSession, path: str) -> StructType:
    """Schema of a stored table; reading it takes a job, so it is done once."""
    return spark.read.parquet(path).schema


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def _pick(number, values: list[str]):
    """The value at the position `number` modulo the number of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def transactions(
    spark: SparkSession, folder: str, columns: Sequence[str] = ALL_COLUMNS, even: bool = False
) -> DataFrame:
    """The wanted columns of the transactions.

    Every line has an order and a supplier, and every supplier a nation and region,
    as the star schema's foreign keys promise. A table that no wanted column comes
    from is therefore not joined. With `even`, lines read by few tasks are dealt out
    to all cores, which pays when much work follows.
    """
    day = F.col("o_orderdate").cast("date")
    available = {
        "basket_num": F.col("l_orderkey"),
        "hshd_num": F.col("o_custkey"),
        "purchase_date": day,
        "product_num": F.col("l_partkey"),
        "spend": F.col("l_extendedprice").cast(MONEY),
        "units": F.col("l_quantity").cast("int"),
        "store_region": F.col("r_name"),
        "week_num": F.weekofyear(day),
        "year": F.year(day),
    }
    lines = _read(spark, folder, "lineitem")
    lines = spread(lines, "l_orderkey", "l_linenumber") if even else lines
    if set(columns) & FROM_ORDERS:
        lines = lines.join(_read(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "store_region" in columns:
        lines = lines.join(_stores(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select(*[available[c].alias(c) for c in columns])


def _stores(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with their region's name, marked for broadcast if few enough."""
    # Nations and regions are fixed lists of 25 and 5 rows.
    places = _read(spark, folder, "nation").join(
        F.broadcast(_read(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    suppliers = _read(spark, folder, "supplier")
    stores = suppliers.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    stores = stores.select("s_suppkey", "r_name")
    return F.broadcast(stores) if fits_broadcast(suppliers) else stores


def households(spark: SparkSession, folder: str) -> DataFrame:
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    income = F.lit(TOP_INCOME)
    for below, name in reversed(INCOME_STEPS):
        income = F.when(balance < below, F.lit(name)).otherwise(income)
    return _read(spark, folder, "customer").select(
        key.alias("hshd_num"),
        F.when(balance >= 5000, F.lit("Y")).otherwise(F.lit("N")).alias("loyalty_flag"),
        _pick(key, AGE_RANGES).alias("age_range"),
        _pick(key, MARITAL).alias("marital_status"),
        income.alias("income_range"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("Homeowner")).otherwise(F.lit("Renter")).alias("homeowner_desc"),
        F.col("c_mktsegment").alias("hshd_composition"),
        (key % 5 + 1).cast("int").alias("hshd_size"),
        (key % 4).cast("int").alias("children"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return _read(spark, folder, "part").select(
        key.alias("product_num"),
        F.col("p_type").alias("department"),
        F.col("p_brand").alias("commodity"),
        F.when(F.col("p_size") <= 25, F.lit("PRIVATE")).otherwise(F.lit("NATIONAL")).alias("brand_type"),
        F.when(key % 5 == 0, F.lit("Y")).otherwise(F.lit("N")).alias("natural_organic_flag"),
    )


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "transactions": transactions(spark, folder),
        "households": households(spark, folder),
        "products": products(spark, folder),
    }
