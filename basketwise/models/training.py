"""Fitting, scoring, evaluating and storing the models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScalerModel, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketwise.models import ensembles
from basketwise.models import features as lists
from basketwise.models.trees import Ensemble, Layout, boost, find_cuts, forest, store_blocks
from basketwise.operators.metrics import clv_tiers
from basketwise.operators.prepare import mark_split
from basketwise.session import ensure_checkpoint_dir, release, stage

# Settings of the three models.
SEED = 42
CHURN_TREES, CHURN_RATE, CHURN_DEPTH = 200, 0.1, 5
CLV_TREES, CLV_DEPTH = 100, 15
PAIR_TREES, PAIR_RATE, PAIR_DEPTH = 50, 0.1, 3
# A node of at least ten rows may be split; the trainer bounds the rows of a leaf instead.
LEAF_ROWS = 5

CHURN_LABEL, CLV_LABEL, PAIR_LABEL = "churned", "clv_12_month", "normalized_count"


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline, the frame it came from and the held-out part of it."""

    model: PipelineModel
    data: DataFrame
    test: DataFrame


def _split(df: DataFrame, key: str, strata: str | None, copied: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, the held-out ones and those to fit on.

    Unless `copied`, the stored frame `df` is not stored again with its halves marked, but only
    the ends of the held-out part, which every reading compares with.
    """
    ensure_checkpoint_dir(df.sparkSession)
    marked = stage(mark_split(df, key, strata)) if copied else mark_split(df, key, strata, stage)
    data = marked.drop("is_test") if copied else df
    return data, marked.where(F.col("is_test") == 1).drop("is_test"), marked.where(F.col("is_test") == 0)


def split_churn(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, "hshd_num", CHURN_LABEL)[:2]


def split_clv(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, "hshd_num", None)[:2]


def split_pairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(_with_pair_key(df), "pair_key", None, False)[:2]


def _with_pair_key(df: DataFrame) -> DataFrame:
    return df.withColumn("pair_key", F.xxhash64("product1", "product2"))


# Trees from stored blocks of rows.
Grow = Callable[[DataFrame, Layout], Ensemble]


def _fit(
    df: DataFrame, key: str, strata: str | None, features: list[str], label: Column, grow: Grow, fill_zero: bool = False, classifier: bool = False, copied: bool = True
) -> Trained:
    data, test, training = _split(df, key, strata, copied)
    prepared = Pipeline(stages=lists.feature_stages(data, features, fill_zero)).fit(training)
    indexers = [s for s in prepared.stages if isinstance(s, StringIndexerModel)]
    coded = [c for s in indexers for c in s.getOutputCols()]
    # Wide text columns are read as codes; their vectors stay for other readers.
    vector = "scaled" if coded else "features"
    known = F.when(label.isNull() | F.isnan(label), F.raise_error("the label of a row to fit on is missing")).otherwise(label)
    rows = prepared.transform(training).select(_scaled(prepared), ensembles.codes(coded), known.alias("label"))
    width = len(lists.feature_names(prepared)) - sum(len(labels) for s in indexers for labels in s.labelsArray)
    layout = Layout(find_cuts(rows, width), [len(labels) for s in indexers for labels in s.labelsArray])
    blocks = store_blocks(rows, layout)
    grown = grow(blocks, layout)
    release(blocks)
    return Trained(PipelineModel([*prepared.stages, ensembles.TreesModel(grown, vector, coded, classifier)]), data, test)


def _scaled(prepared: PipelineModel) -> Column:
    """The numbers that the scaler's vector holds, as the trees read them, from its columns: no vector is made for them."""
    names = next(s for s in prepared.stages if isinstance(s, VectorAssembler)).getInputCols()
    scaler = next(s for s in prepared.stages if isinstance(s, StandardScalerModel))
    numbers = []
    for name, mean, deviation in zip(names, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()):
        number = F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(float("nan")))
        numbers.append((number - F.lit(mean)) * F.lit(1.0 / deviation if deviation else 0.0))
    return F.array(*numbers).cast("array<double>").alias("values")


def train_churn(
    df: DataFrame, trees: int = CHURN_TREES, rate: float = CHURN_RATE, depth: int = CHURN_DEPTH, seed: int = SEED
) -> Trained:
    """Boosted classifier of the churn label, split by household within each label.

    `df` is a stored frame of churn features. Nothing is drawn, so `seed` changes nothing.
    """

    def grow(blocks: DataFrame, layout: Layout) -> Ensemble:
        return boost(blocks, layout, "logistic", trees, rate, depth, LEAF_ROWS)

    label = F.col(CHURN_LABEL).cast("double")
    binary = F.when(label.isin(0.0, 1.0), 2 * label - 1).otherwise(F.lit(None))
    return _fit(df, "hshd_num", CHURN_LABEL, lists.churn_features(df), binary, grow, classifier=True)


def train_clv(df: DataFrame, trees: int = CLV_TREES, depth: int = CLV_DEPTH, seed: int = SEED) -> Trained:
    """Random forest for the twelve-month value; `df` is a stored frame of value features."""

    def grow(blocks: DataFrame, layout: Layout) -> Ensemble:
        return forest(blocks, layout, trees, depth, LEAF_ROWS, seed)

    return _fit(df, "hshd_num", None, lists.clv_features(df), F.col(CLV_LABEL).cast("double"), grow)


def train_pair_model(
    df: DataFrame, trees: int = PAIR_TREES, rate: float = PAIR_RATE, depth: int = PAIR_DEPTH, seed: int = SEED
) -> Trained:
    """Boosted regressor of the normalized pair count; `df` is a stored pair frame. Nothing is drawn, so `seed` changes nothing."""

    def grow(blocks: DataFrame, layout: Layout) -> Ensemble:
        return boost(blocks, layout, "squared", trees, rate, depth, 1)

    frame = _with_pair_key(df)
    return _fit(frame, "pair_key", None, lists.pair_features(df), F.col(PAIR_LABEL).cast("double"), grow, fill_zero=True, copied=False)


def score_churn(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Churn probability of every household of the feature frame."""
    probability = vector_to_array(F.col("probability"))[1]
    return model.transform(df).withColumn("churn_prob", probability).select(*df.columns, "churn_prob", "prediction")


def score_clv(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted value and its quartile tier for every household of the feature frame."""
    scored = stage(
        model.transform(df).withColumn("predicted_clv", F.col("prediction")).select(*df.columns, "predicted_clv")
    )
    return clv_tiers(scored, "predicted_clv")


def score_pairs(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predicted normalized count of every pair."""
    return model.transform(df).select(*df.columns, "prediction")


def churn_risk(scored: DataFrame, n: int | None = None) -> DataFrame:
    """Households by falling churn probability; the first `n` if given."""
    ranked = scored.select("hshd_num", "churn_prob").orderBy(F.desc("churn_prob"), "hshd_num")
    return ranked if n is None else ranked.limit(n)


def clv_ranking(scored: DataFrame) -> DataFrame:
    """Households by falling predicted value."""
    return scored.select("hshd_num", "predicted_clv").orderBy(F.desc("predicted_clv"), "hshd_num")


def feature_importance(model: PipelineModel, n: int | None = 10, spark: SparkSession | None = None) -> DataFrame:
    """Features by falling importance; the first `n` if given."""
    spark = spark or SparkSession.getActiveSession()
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(lists.feature_names(model), weights))
    ranked = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked if n is None else ranked.limit(n)


def save_model(model: PipelineModel, path: str) -> None:
    """Store encoders, scaler, feature names and trees together."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
