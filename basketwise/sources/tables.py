"""The three tables and the stored artefacts as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise import batches
from basketwise.schema import MONTH, TABLES
from basketwise.session import hadoop_path

# Database column names that differ from the model's.
DATABASE_NAMES = {"Date": "purchase_date"}

# The folders of a batch's accepted and rejected rows are named by this column.
ACCEPTED = "accepted"

# What a parallel read of a table needs.
PARALLEL = ["partitionColumn", "lowerBound", "upperBound", "numPartitions"]


def conform(df: DataFrame, kind: str) -> DataFrame:
    """Project `df` to the columns and types of table `kind`."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[kind].fields])


def load_tables(spark: SparkSession, source: str | Mapping[str, str]) -> dict[str, DataFrame]:
    """All three tables, whole, from a folder or from a JDBC database.

    `source` is the parent folder, of loaded batches or of one Parquet folder per table, or the JDBC options of the caller. A table's
    own options are given under "<table>.<option>". The transactions are read in
    parallel, so partitionColumn, lowerBound, upperBound and numPartitions are required.
    """
    if isinstance(source, str):
        return {kind: load_table(spark, source, kind) for kind in TABLES}
    return {
        kind: conform(
            spark.read.format("jdbc").options(**jdbc_options(source, kind)).load().withColumnsRenamed(DATABASE_NAMES), kind
        )
        for kind in TABLES
    }


def load_table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """A table of a folder: the accepted rows of its committed batches, and the plain folder of the table if there is one."""
    found = batches.paths(spark, folder, f"{kind}/{ACCEPTED}=true")
    return _read_parts(spark, [*found, f"{folder}/{kind}"], TABLES[kind])


def load_rejects(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The rows of committed batches that were not stored, with their reject_reason."""
    found = batches.paths(spark, folder, f"{kind}/{ACCEPTED}=false")
    return _read_parts(spark, found, T.StructType([*TABLES[kind].fields, T.StructField("reject_reason", T.StringType())]))


def _read_parts(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Those of the folders that exist; a batch without such rows has none."""
    present = [path for path in paths if (place := hadoop_path(spark, path))[1].exists(place[0])]
    return spark.read.schema(schema).parquet(*present) if present else spark.createDataFrame([], schema)


def read_by_month(spark: SparkSession, path: str) -> DataFrame:
    """Lines stored by month, with their month; `customers.split_period` reads the months of its window only."""
    return spark.read.schema(T.StructType([*TABLES["transactions"].fields, T.StructField(MONTH, T.DateType())])).parquet(path)


def register_by_household(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """Make the bucketed files at `path`, written by any session, table `name` of this one."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["transactions"].fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY (hshd_num) SORTED BY (hshd_num, basket_num) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def jdbc_options(options: Mapping[str, str], kind: str) -> dict[str, str]:
    """Shared options plus those of one table; the table name defaults to its kind."""
    shared = {key: value for key, value in options.items() if key.split(".", 1)[0] not in TABLES}
    own = {key.split(".", 1)[1]: value for key, value in options.items() if key.startswith(f"{kind}.")}
    merged = {**shared, **own}
    if "query" not in merged:
        merged.setdefault("dbtable", kind)
    missing = [name for name in PARALLEL if name not in merged]
    if kind == "transactions" and missing:
        raise ValueError(f"transactions would be read by one task; give {', '.join(missing)}")
    return merged


def read_artifact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored result table: details, recommendations, top pairs or customer stats."""
    return spark.read.parquet(f"{folder}/{name}")
