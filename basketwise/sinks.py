"""Writers of tables, artefacts, CSV and JSON rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.operators.skew import join_spread
from basketwise.schema import MONTH
from basketwise.session import stage

# Buckets of lines stored by household.
BUCKETS = 64

# Reasons of valid rows that are not stored because of their key.
STORED_KEY, REPEATED_KEY = "key already stored", "key repeated in the file"


def append_table(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table; existing rows are kept, so a file loaded twice is stored twice."""
    df.write.mode("append").parquet(path)


def mark_duplicates(df: DataFrame, stored: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Give `reason`, null so far, to rows whose key `stored` or another row of `df` has.

    Of equal keys in `df` the last row in the order of all its columns is kept, so a
    repeated load decides alike. The winner of a key is found by an aggregation that is
    combined before its shuffle, and rows learn of it by their own number, so a key that
    very many rows share is no large group.
    """
    columns = [c for c in df.columns if c != reason]
    # The stored copy fixes the numbers.
    numbered = stage(df.withColumn("row_number", F.monotonically_increasing_id()))
    valid = numbered.where(F.col(reason).isNull())
    # Nulls come before all values, as in a falling order with nulls last.
    last = F.max(F.struct(*[F.col(c) for c in columns], "row_number")).alias("last")
    winners = valid.groupBy(*keys).agg(last).select(F.col("last.row_number").alias("row_number"), F.lit(True).alias("first"))
    held = join_spread(valid.select(*keys, "row_number"), stored.select(*keys).distinct(), keys, "left_semi")
    held = held.select("row_number", F.lit(True).alias("held"))
    marked = numbered.join(winners, "row_number", "left").join(held, "row_number", "left")
    why = F.when(F.col("held"), F.lit(STORED_KEY)).when(F.col("first").isNull(), F.lit(REPEATED_KEY))
    return marked.select(*columns, F.when(F.col(reason).isNotNull(), F.col(reason)).otherwise(why).alias(reason))


def write_by_month(lines: DataFrame, path: str) -> None:
    """Replace a Parquet table of lines partitioned by purchase month, so that a window of dates reads its months only."""
    dated = lines.withColumn(MONTH, F.trunc("purchase_date", "month"))
    dated.write.mode("overwrite").partitionBy(MONTH).parquet(path)


def write_by_household(lines: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Replace table `name`, its files at `path`, with lines in `buckets` buckets by household, sorted within them.

    What is grouped or joined by household on the returned table needs no shuffle. Another
    session finds it after `sources.tables.register_by_household`. A bucket is one task:
    there should be enough of them for the largest household to be a small part of one.
    """
    spark = lines.sparkSession
    dealt = lines.repartition(buckets, "hshd_num")
    dealt.write.mode("overwrite").bucketBy(buckets, "hshd_num").sortBy("hshd_num", "basket_num").option("path", path).saveAsTable(name)
    return spark.table(name)


def append_jdbc(df: DataFrame, options: dict[str, str]) -> None:
    """Append rows to a database table; the caller gives url, dbtable and credentials."""
    df.write.format("jdbc").options(**options).mode("append").save()


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index, one file per partition; blanks stay and quotes are doubled."""
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quote": '"', "escape": '"'}
    df.write.mode("overwrite").options(header=True, **exact).csv(path)


def write_artifact(df: DataFrame, folder: str, name: str) -> None:
    """Replace a stored result table."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row; null fields are kept."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))
