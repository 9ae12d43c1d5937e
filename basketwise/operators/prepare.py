"""Cleaning, encoding, splitting and scaling of feature frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise.functions.ratios import finite_or_null

MAX_CATEGORIES = 2_000

# Fixed values of the split: multiplier and modulus of the hash, parts of the hash
# range, and the share of test rows as parts of a whole.
HASH_FACTOR, HASH_SPAN = 2654435761, 4294967296
SPLIT_RANGES = 16_384
TEST_PARTS, ALL_PARTS = 1, 4


def clean_features(df: DataFrame, columns: Sequence[str], fill_zero: bool = False) -> DataFrame:
    """Infinite and NaN values become null, or 0 with `fill_zero`."""
    cleaned = {c: finite_or_null(F.col(c)) for c in columns}
    if fill_zero:
        cleaned = {c: F.coalesce(v, F.lit(0.0)) for c, v in cleaned.items()}
    return df.withColumns(cleaned)


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null values become the mean of their column."""
    doubles = df.withColumns({c: F.col(c).cast("double") for c in columns})
    filled = [f"{c}__filled" for c in columns]
    imputed = Imputer(strategy="mean", inputCols=list(columns), outputCols=filled).fit(doubles).transform(doubles)
    return imputed.withColumns({c: F.col(f) for c, f in zip(columns, filled)}).select(*df.columns)


def categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values per text column, from one pass.

    Each becomes a column, so more than `limit` in all raises.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])
    found = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} categories in {', '.join(columns)}")
    return {c: sorted(row["value"] for row in found if row["name"] == c) for c in columns}


def text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of `columns` that hold text and so need encoding."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(kinds.get(c), T.StringType)]


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    drop_first: bool = True,
    dummy_na: bool = False,
    known: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Replace text columns by 0/1 columns <column>_<value>; number columns stay.

    The first value in order is left out with `drop_first`. Null gives zeros, and
    with `dummy_na` a 1 in <column>_nan.
    """
    encoded = text_columns(df, columns)
    known = (categories(df, encoded) if encoded else {}) if known is None else known
    indicators = []
    for name in encoded:
        column = F.col(name)
        for value in list(known[name])[1 if drop_first else 0 :]:
            indicators.append(F.coalesce((column == F.lit(value)).cast("int"), F.lit(0)).alias(f"{name}_{value}"))
        if dummy_na:
            indicators.append(column.isNull().cast("int").alias(f"{name}_nan"))
    return df.select(*[F.col(c) for c in df.columns if c not in encoded], *indicators)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sparse_stages(df: DataFrame, columns: Sequence[str], drop_first: bool = True) -> tuple[list, list[str]]:
    """Pipeline stages that turn text columns of any number of values into sparse 0/1 vectors, and the vectors' names.

    The first value in order is left out with `drop_first`; null, the first value and values
    not met in fitting give zeros. The values are part of the fitted stages.
    """
    firsts = df.agg(*[F.min(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    named, indexed, vectors = ([f"{kind} {c}" for c in columns] for kind in ("value", "index", "onehot"))
    parts = []
    for i, (c, name) in enumerate(zip(columns, named)):
        first = firsts[f"c{i}"]
        value = f"NULLIF({quoted(c)}, {literal(first)})" if drop_first and first is not None else quoted(c)
        parts.append(f"{value} AS {quoted(name)}")
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"),
        StringIndexer(inputCols=named, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        # The last index stands for null and unknown values.
        OneHotEncoder(inputCols=indexed, outputCols=vectors, dropLast=True),
    ], vectors


def one_hot_vector(
    df: DataFrame, columns: Sequence[str], output: str = "encoded", drop_first: bool = True, dummy_na: bool = False
) -> tuple[DataFrame, PipelineModel]:
    """`df` with one sparse vector in place of its text columns, as `one_hot` has it in columns, for any number of values.

    With `dummy_na` a last entry per column is 1 for null. Also returns the fitted stages, which
    encode other rows alike; `vector_names` lists the entries.
    """
    encoded = text_columns(df, columns)
    stages, vectors = sparse_stages(df, encoded, drop_first)
    inputs = []
    for c, vector in zip(encoded, vectors):
        inputs += [vector, f"missing {c}"] if dummy_na else [vector]
    if dummy_na:
        flags = ", ".join(f"CAST({quoted(c)} IS NULL AS DOUBLE) AS {quoted(f'missing {c}')}" for c in encoded)
        stages.append(SQLTransformer(statement=f"SELECT *, {flags} FROM __THIS__"))
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol=output)]).fit(df)
    kept = [quoted(c) for c in df.columns if c not in encoded]
    return model.transform(df).select(*kept, output), model


def vector_names(model: PipelineModel) -> list[str]:
    """Names of the entries of a vector of `one_hot_vector`, in order."""
    indexer = next(s for s in model.stages if s.hasParam("stringOrderType"))
    labels = dict(zip((c.replace("index ", "onehot ", 1) for c in indexer.getOutputCols()), indexer.labelsArray))
    names = []
    for c in model.stages[-1].getInputCols():
        kind, column = c.split(" ", 1)
        names += [f"{column}_nan"] if kind == "missing" else [f"{column}_{value}" for value in labels[c]]
    return names


def mark_split(df: DataFrame, key: str, strata: str | None = None, held: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add is_test: in each stratum the quarter of the rows with the smallest key hash.

    The hash spreads evenly over its range, so the range is cut into equal parts and
    counting the parts tells which of them holds the quarter's end. Only the rows of
    that part are ordered, to find the last test row; all others are compared with it.
    Rows that repeat a key stay together. Rows with a null key are not counted and are
    training rows. `df` is read twice and should be a stored frame. `held` may store the last
    test rows, one for each stratum; every later reading of the result then only compares.
    """
    hashed = F.pmod(F.pmod(F.col(key), F.lit(HASH_SPAN // 2)) * F.lit(HASH_FACTOR), F.lit(HASH_SPAN))
    placed = df.withColumn("split_hash", hashed).withColumn("split_stratum", F.col(strata) if strata else F.lit(0))
    part = F.floor(F.col("split_hash") * SPLIT_RANGES / F.lit(HASH_SPAN)).cast("int")
    keys = placed.where(F.col(key).isNotNull()).select(
        "split_stratum", "split_hash", F.col(key).alias("split_key"), part.alias("part")
    )
    # At most SPLIT_RANGES rows per stratum.
    sizes = keys.groupBy("split_stratum", "part").agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("split_stratum")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    wanted = F.ceil(F.sum("size").over(whole) * TEST_PARTS / F.lit(ALL_PARTS))
    ends = sizes.select(F.col("split_stratum").alias("stratum"), "part", "size", (wanted - offset).alias("left"))
    ends = ends.where((F.col("left") > 0) & (F.col("left") <= F.col("size"))).drop("size")
    # One row where there is one stratum: the keys need not be shuffled to meet it.
    ends = ends if strata else F.broadcast(ends)
    inside = keys.join(ends, (F.col("split_stratum").eqNullSafe(F.col("stratum"))) & (keys["part"] == ends["part"]))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("split_hash", "split_key"))
    last = inside.select("stratum", "left", "split_hash", "split_key", rank.alias("rank")).where("rank = left")
    last = last.select("stratum", F.col("split_hash").alias("last_hash"), F.col("split_key").alias("last_key"))
    last = last if held is None else held(last)
    until = (F.col("split_hash") < F.col("last_hash")) | (
        (F.col("split_hash") == F.col("last_hash")) & (F.col(key) <= F.col("last_key"))
    )
    joined = placed.join(last, F.col("split_stratum").eqNullSafe(F.col("stratum")), "left")
    return joined.select(*[placed[c] for c in df.columns], F.coalesce(until.cast("int"), F.lit(0)).alias("is_test"))


def split(df: DataFrame, key: str, strata: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; the same rows on every run."""
    marked = mark_split(df, key, strata)
    return (
        marked.where(F.col("is_test") == 0).drop("is_test"),
        marked.where(F.col("is_test") == 1).drop("is_test"),
    )


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Columns minus mean over population deviation, both taken from `fit_on`.

    A constant column is only centred.
    """
    fit_on = df if fit_on is None else fit_on
    moments = fit_on.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    row = moments.select(F.struct(*moments.columns).alias("moments")).scalar()
    scaled = {}
    for i, c in enumerate(columns):
        deviation = F.col(f"fitted_moments.s{i}")
        centred = F.col(c).cast("double") - F.col(f"fitted_moments.m{i}")
        scaled[c] = centred / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)
    return df.withColumn("fitted_moments", row).withColumns(scaled).drop("fitted_moments")
