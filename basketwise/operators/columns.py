"""Column naming, selection, alignment and text standardization."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise.functions import text
from basketwise.schema import CSV_NAMES


def strip_columns(df: DataFrame) -> DataFrame:
    """Cut blanks around the column names."""
    return df.toDF(*[name.strip() for name in df.columns])


def standardize_columns(df: DataFrame) -> DataFrame:
    """Cut blanks around the column names and put them in capitals."""
    return df.toDF(*[name.strip().upper() for name in df.columns])


def rename_to_model(df: DataFrame, kind: str, keep: Mapping[str, str] | None = None) -> DataFrame:
    """Extract header names to model names; a missing column raises, others but those of `keep` are left out."""
    names = CSV_NAMES[kind]
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{kind}: columns missing: {', '.join(missing)}")
    return df.select(*[F.col(name).alias(target) for name, target in {**names, **(keep or {})}.items()])


def columns_of_type(df: DataFrame, kind: type[T.DataType] | tuple[type[T.DataType], ...]) -> list[str]:
    """Names of the columns of a type, such as `StringType` or `NumericType`."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def columns_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [name for name in df.columns if name.startswith(prefixes)]


def prefix_columns(df: DataFrame, prefix: str, except_: str) -> DataFrame:
    """Put `prefix` before every column name but the key's."""
    return df.select(*[F.col(c) if c == except_ else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def has_columns(df: DataFrame, names: Iterable[str]) -> bool:
    return set(names) <= set(df.columns)


def align_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exactly the listed features in order: nulls and absent columns give 0, others go."""
    present = set(df.columns)
    return df.select(
        *keys,
        *[
            (F.coalesce(F.col(f"`{name}`"), F.lit(0)) if name in present else F.lit(0)).alias(name)
            for name in features
        ],
    )


def concat_columns(df: DataFrame, extra: Mapping[str, Column]) -> DataFrame:
    """Encoded columns beside the existing ones of the same row."""
    return df.withColumns(dict(extra))


def dept_column(department: Column) -> Column:
    """Feature name of a department: small letters, blanks to underscores."""
    return F.concat(F.lit("dept_"), F.replace(F.lower(department), F.lit(" "), F.lit("_")))


def trim_strings(df: DataFrame) -> DataFrame:
    """Cut white space around every text value."""
    return _on_strings(df, text.strip)


def trim_strings_right(df: DataFrame) -> DataFrame:
    """Cut trailing white space of every text value."""
    return _on_strings(df, text.strip_right)


def standardize_nulls(df: DataFrame) -> DataFrame:
    """Every null text, and the word null in any case, becomes 'null'."""
    return _on_strings(df, text.null_word)


def _on_strings(df: DataFrame, change) -> DataFrame:
    names = columns_of_type(df, T.StringType)
    return df.withColumns({name: change(F.col(name)) for name in names}) if names else df


def long_form(df: DataFrame, values: Mapping[str, Column], name: str, value: str) -> DataFrame:
    """Turn computed columns of `df` into (name, value) rows."""
    entries = [F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in values.items()]
    return df.select(F.inline(F.array(*entries)))
