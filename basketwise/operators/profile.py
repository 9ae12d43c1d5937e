"""Dataset profile and null reports, each from one aggregation pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.operators.columns import long_form


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and number of non-null values."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows, as a profile shows them."""
    return df.limit(n)


def null_columns(df: DataFrame) -> DataFrame:
    """One row per column: whether any of its values is null or NaN."""
    flags = []
    for i, (name, kind) in enumerate(df.dtypes):
        column = F.col(f"`{name}`")
        missing = column.isNull() | F.isnan(column) if kind in ("double", "float") else column.isNull()
        flags.append(F.coalesce(F.max(missing), F.lit(False)).alias(f"c{i}"))
    return long_form(
        df.agg(*flags), {name: F.col(f"c{i}") for i, name in enumerate(df.columns)}, "column_name", "has_null"
    )


def row_counts(**frames: DataFrame) -> DataFrame:
    """One row per named frame with its number of rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in frames.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
