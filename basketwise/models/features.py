"""Feature lists of the three models and the pipeline stages that build vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise.operators.columns import columns_with_prefix
from basketwise.operators.prepare import categories, literal, quoted, sparse_stages, text_columns
from basketwise.schema import DEMOGRAPHICS

# The numeric features of each model.
CHURN_NUMERIC = [
    "purchase_count",
    "total_spend",
    "total_units",
    "avg_basket_value",
    "unique_products",
    "tenure",
    "purchase_frequency",
    "spend_per_visit",
    "product_diversity_ratio",
]
CLV_NUMERIC = [
    "purchase_count",
    "total_spend",
    "total_units",
    "avg_basket_value",
    "unique_products",
    "tenure",
    "purchase_frequency",
    "recency",
    "spend_per_day",
    "spend_per_visit",
    "product_diversity",
]
PAIR_COMBINED = ["total_frequency", "price_similarity", "same_department"]

RAW, READY = "raw ", "feature "

# Text columns of more values than about this become sparse vectors instead of columns.
INLINE_VALUES = 200


def churn_features(df: DataFrame) -> list[str]:
    """Nine numbers, and the demographics the frame has."""
    return CHURN_NUMERIC + _demographics(df)


def clv_features(df: DataFrame) -> list[str]:
    """Eleven numbers, the department columns, and the demographics the frame has."""
    return CLV_NUMERIC + columns_with_prefix(df, "dept_") + _demographics(df)


def pair_features(df: DataFrame) -> list[str]:
    """The numeric columns of both products and the three combined ones."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return [c for c in numeric if c.startswith(("p1_", "p2_"))] + [c for c in PAIR_COMBINED if c in numeric]


def _demographics(df: DataFrame) -> list[str]:
    return [c for c in DEMOGRAPHICS if c in df.columns]


def feature_stages(df: DataFrame, features: Sequence[str], fill_zero: bool = False, inline_values: int = INLINE_VALUES) -> list:
    """Pipeline stages from a feature frame to the vector column `features`.

    Text columns become 0/1 entries without their first value: columns, or a sparse vector
    for a column of more than about `inline_values` values. Missing and infinite numbers
    become the mean of the fitted rows, or 0 with `fill_zero`. All of it is stored with
    the model, so scoring sees the features the training saw.
    """
    text = text_columns(df, features)
    numbers = [c for c in features if c not in text]
    wide = _wide(df, text, inline_values)
    text = [c for c in text if c not in wide]
    # The estimate of the number of values may be a few percent off.
    known = categories(df, text, 2 * inline_values * len(text) + 1) if text else {}
    selected, outputs = [], []
    for name in numbers:
        value = f"CAST({quoted(name)} AS DOUBLE)"
        finite = f"CASE WHEN ABS({value}) < CAST('Infinity' AS DOUBLE) THEN {value} END"
        target = READY if fill_zero else RAW
        selected.append(f"{f'COALESCE({finite}, 0D)' if fill_zero else finite} AS {quoted(target + name)}")
        outputs.append(READY + name)
    for name in text:
        for value in known[name][1:]:
            column = READY + _safe(f"{name}_{value}")
            selected.append(f"CASE WHEN {quoted(name)} = {literal(value)} THEN 1D ELSE 0D END AS {quoted(column)}")
            outputs.append(column)
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(selected)} FROM __THIS__")]
    if not fill_zero:
        stages.append(
            Imputer(strategy="mean", inputCols=[RAW + c for c in numbers], outputCols=[READY + c for c in numbers])
        )
    stages.append(VectorAssembler(inputCols=outputs, outputCol="assembled", handleInvalid="keep"))
    scaled = "scaled" if wide else "features"
    stages.append(StandardScaler(inputCol="assembled", outputCol=scaled, withMean=True, withStd=True))
    if wide:
        # Centring would make the vectors dense, and trees do not need it.
        encoders, vectors = sparse_stages(df, wide)
        stages += [*encoders, VectorAssembler(inputCols=[scaled, *vectors], outputCol="features")]
    return stages


def _wide(df: DataFrame, text: Sequence[str], inline_values: int) -> list[str]:
    """The text columns of more than about `inline_values` values."""
    if not text:
        return []
    found = df.agg(*[F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(text)]).first()
    return [c for i, c in enumerate(text) if found[f"c{i}"] > inline_values]


def _safe(name: str) -> str:
    """A dot would be read as a path into a nested column."""
    return name.replace(".", "_")


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the vector's entries, in order."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    names = [name.removeprefix(READY) for name in assembler.getInputCols()]
    for indexer in (s for s in model.stages if isinstance(s, StringIndexerModel)):
        for column, labels in zip(indexer.getInputCols(), indexer.labelsArray):
            names += [f"{column.removeprefix('value ')}_{value}" for value in labels]
    return names
