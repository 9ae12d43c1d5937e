"""Cleaning and loading of the three CSV extracts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketwise import batches
from basketwise.functions import dates, text
from basketwise.operators.columns import standardize_nulls, strip_columns, trim_strings, trim_strings_right
from basketwise.schema import REQUIRED, TABLES
from basketwise.session import staging
from basketwise.sinks import REPEATED_KEY, STORED_KEY, mark_duplicates
from basketwise.sources.csv_files import MALFORMED, read_retail_csv
from basketwise.sources.tables import ACCEPTED, load_table

REASON = "reject_reason"
COUNTED = ["input_rows", "good_rows", "rejected_rows", "duplicate_rows"]


# The steps of cleaning a transactions file, in order.
CLEANING: dict[str, Callable[[DataFrame], DataFrame]] = {
    "names cut": strip_columns,
    "values cut": trim_strings,
    "nulls named": standardize_nulls,
    "ends cut": trim_strings_right,
    "numbers and dates read": lambda df: df.withColumns(
        {
            "WEEK_NUM": text.to_int_or_null(F.col("WEEK_NUM")),
            "YEAR": text.to_int_or_null(F.col("YEAR")),
            "PURCHASE_": dates.parse_purchase_date(F.col("PURCHASE_")),
        }
    ),
}


def clean_transactions(raw: DataFrame) -> DataFrame:
    """A raw transactions file, all text, with standard nulls, whole numbers and dates.

    Keys and amounts stay text; week and year become whole numbers or null, the
    purchase date a date or null.
    """
    return _cleaned(raw, lambda df, step: df)


def store_cleaned(raw: DataFrame, path: str) -> DataFrame:
    """Write the cleaned file and count, on the way, what every step was given and what it made of it.

    One row per step and column: rows, nulls, values that are a word for null, and values
    with blanks around them. Step "raw" is the file itself.
    """
    seen: dict[str, Observation] = {}
    names: dict[str, list[str]] = {}

    def watch(df: DataFrame, step: str) -> DataFrame:
        seen[step], names[step] = Observation(), df.columns
        counts = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(df.columns):
            value = F.col(f"`{name}`").cast("string")
            counts.append(F.count_if(value.isNull()).alias(f"nulls{i}"))
            counts.append(F.count_if(F.lower(F.trim(value)) == "null").alias(f"words{i}"))
            counts.append(F.count_if(value != F.trim(value)).alias(f"padded{i}"))
        return df.observe(seen[step], *counts)

    _cleaned(raw, watch).write.parquet(path)
    rows = []
    for place, (step, observed) in enumerate(seen.items()):
        found = observed.get
        for i, name in enumerate(names[step]):
            rows.append((place, step, name.strip(), found["rows"], found[f"nulls{i}"], found[f"words{i}"], found[f"padded{i}"]))
    schema = "place int, step string, column_name string, rows long, nulls long, null_words long, padded long"
    return raw.sparkSession.createDataFrame(rows, schema)


def _cleaned(raw: DataFrame, watch: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    frame = watch(raw, "raw")
    for step, clean in CLEANING.items():
        frame = watch(clean(frame), step)
    return frame


def type_rows(raw: DataFrame, kind: str) -> DataFrame:
    """Text columns of table `kind` in the table's types, and a reject reason or null.

    Text is cut, tested and converted in steps, so that each value is converted
    once although both the result and the reason depend on it.
    """
    fields = {f.name: f.dataType.simpleString() for f in TABLES[kind].fields}
    broken = F.col(MALFORMED) if MALFORMED in raw.columns else F.lit(None).cast("string")
    cut = raw.select(*[text.strip(F.col(name)).alias(name) for name in fields], broken.alias(MALFORMED))
    numeric = [name for name, sort in fields.items() if sort not in ("date", "string")]
    tested = cut.withColumns({f"{name} number": text.number_text(F.col(name)) for name in numeric})
    parsed = tested.withColumns(
        {f"{name} value": _convert(name, sort) for name, sort in fields.items() if sort != "string"}
    )
    zero = {name for name, sort in fields.items() if sort == "int" or sort.startswith("decimal")}
    if kind == "products":
        zero.add("product_num")
    typed, problems = [], [(F.col(MALFORMED).isNotNull(), "wrong number of fields")]
    for name, sort in fields.items():
        value = F.col(name if sort == "string" else f"{name} value")
        if name in zero:
            problems.append((F.col(f"{name} number").isNotNull() & value.isNull(), f"{name} out of range"))
            value = F.coalesce(value, F.lit(0).cast(sort))
        elif name in REQUIRED[kind]:
            problems.append((value.isNull(), f"{name} missing or unreadable"))
        typed.append(value.alias(name))
    reason: Column = F.lit(None).cast("string")
    for bad, why in reversed(problems):
        reason = F.when(bad, F.lit(why)).otherwise(reason)
    return parsed.select(*typed, reason.alias(REASON))


def _convert(name: str, sort: str) -> Column:
    number = F.col(f"{name} number")
    if sort == "date":
        return dates.parse_any_date(F.col(name))
    if sort == "int":
        return text.as_int(number)
    if sort == "bigint":
        return text.as_long(number)
    return number.try_cast(sort)


def split_valid(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be loaded, and rejects with their reason.

    Rows go through an array of one: a test of the reason would else be moved below the
    conversions and into the joins under them, where it converts every value several times more.
    """
    typed = typed.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in typed.columns]))))
    return typed.where(F.col(REASON).isNull()).drop(REASON), typed.where(F.col(REASON).isNotNull())


def _count_columns() -> list[Column]:
    """Input, loadable, rejected and duplicate rows; the last three add up to the first."""
    duplicate = F.coalesce(F.col(REASON).isin(STORED_KEY, REPEATED_KEY), F.lit(False))
    counts = [F.count(F.lit(1)), F.count_if(F.col(REASON).isNull()), F.count_if(F.col(REASON).isNotNull() & ~duplicate), F.count_if(duplicate)]
    return [count.alias(name) for count, name in zip(counts, COUNTED)]


def load_counts(typed: Mapping[str, DataFrame]) -> DataFrame:
    """The counts of typed tables that are not being stored, each from one pass."""
    parts = [df.agg(*_count_columns()).select(F.lit(kind).alias("table_name"), *COUNTED) for kind, df in typed.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def check_batch(paths: Mapping[str, str | None]) -> None:
    """All three files must be given before anything is read or written."""
    if not all(paths.get(kind) for kind in TABLES):
        raise ValueError("all three files are required: transactions, households, products")


def store_typed(typed: DataFrame, path: str) -> dict[str, int]:
    """Write typed rows, accepted and rejected ones apart, and count them on the way; the counts by name."""
    seen = Observation()
    marked = typed.observe(seen, *_count_columns()).withColumn(ACCEPTED, F.col(REASON).isNull())
    marked.write.partitionBy(ACCEPTED).parquet(path)
    return {name: seen.get[name] for name in COUNTED}


def ingest(
    spark: SparkSession,
    paths: Mapping[str, str],
    target: str,
    dedupe_keys: Mapping[str, Sequence[str]] | None = None,
    multi_line: bool = False,
    batch: str | None = None,
    on_stored: Callable[[str], None] | None = None,
) -> DataFrame:
    """Load the three extracts as one batch under `target`; returns the counts.

    Each file is parsed, written and counted in one pass; rows that cannot be loaded are kept
    with their reasons (`sources.tables.load_rejects`). All three tables appear together or,
    if anything fails, not at all. A batch with a name is loaded once: repeating it changes
    nothing and returns its counts. Without a name every load is a new one.

    Only for tables with `dedupe_keys` is one row stored per key; the rows that lose are
    rejects too. Such loads of one target must follow each other. `on_stored` is called
    with each table's name after it is written.
    """
    check_batch(paths)

    def write(folder: str) -> dict:
        counts = {}
        with staging(spark):
            for kind in TABLES:
                typed = type_rows(read_retail_csv(spark, paths[kind], kind, multi_line), kind)
                if dedupe_keys and dedupe_keys.get(kind):
                    typed = mark_duplicates(typed, load_table(spark, target, kind), dedupe_keys[kind], REASON)
                counts[kind] = store_typed(typed, f"{folder}/{kind}")
                if on_stored:
                    on_stored(kind)
        return counts

    counts = batches.store(spark, target, batch, write).notes
    rows = [(kind, *(counts[kind][name] for name in COUNTED)) for kind in TABLES]
    return spark.createDataFrame(rows, "table_name string, " + ", ".join(f"{name} long" for name in COUNTED))
