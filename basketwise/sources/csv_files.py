"""Retail CSV extracts: every column is read as text and typed afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from basketwise.operators.columns import rename_to_model, standardize_columns

# Column with the raw text of rows that have too few or too many fields.
MALFORMED = "malformed_row"


def read_csv_text(spark: SparkSession, path: str, malformed: bool = False, multi_line: bool = False) -> DataFrame:
    """The file as it is: header names with their padding, all columns text.

    Quotes inside quoted text are doubled. With `malformed`, a column of that name holds
    the text of rows whose number of fields differs from the header's. Quoted line ends
    need `multi_line`, which makes each file one task.
    """
    reader = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line)
    found = reader.csv(path)
    if not malformed:
        return found
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in found.columns], T.StructField(MALFORMED, T.StringType())])
    return reader.options(columnNameOfCorruptRecord=MALFORMED, columnPruning=False, mode="PERMISSIVE").schema(schema).csv(path)


def read_retail_csv(spark: SparkSession, path: str, kind: str, multi_line: bool = False) -> DataFrame:
    """An extract of table `kind` under the model's column names, still text, with MALFORMED."""
    raw = read_csv_text(spark, path, malformed=True, multi_line=multi_line)
    return rename_to_model(standardize_columns(raw), kind, {MALFORMED.upper(): MALFORMED})
