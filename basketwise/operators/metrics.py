"""Correlations, histogram, value tiers and model evaluation as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise.functions.labels import value_range
from basketwise.operators.columns import long_form
from basketwise.operators.ranking import exact_quantiles, running_totals, value_totals
from basketwise.session import stage

# The tiers from lowest to highest and the quartiles between them.
TIERS = ["Bronze", "Silver", "Gold", "Platinum"]
QUARTILES = [0.25, 0.5, 0.75]

# Counters of the binned area under the ROC curve.
AUC_BINS = 10_000


def _correlation(x: Column, y: Column) -> Column:
    """Pearson over the rows where both are known; null where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def churn_correlations(df: DataFrame, features: Sequence[str], label: str = "churned") -> DataFrame:
    """Correlation of each feature with the label, all from one pass."""
    target = F.col(label).cast("double")
    row = df.agg(*[_correlation(F.col(f"`{f}`").cast("double"), target).alias(f"c{i}") for i, f in enumerate(features)])
    return long_form(row, {f: F.col(f"c{i}") for i, f in enumerate(features)}, "feature", "correlation")


def clv_histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed.

    Equal values get a range of one around them. A value is put right against the
    edges after the division, so that rounding never moves it over an edge.
    """
    number = F.col(value).cast("double")
    known = df.select(number.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = known.agg(F.min("v").alias("low"), F.max("v").alias("high")).where(F.col("low").isNotNull())
    flat = F.col("low") == F.col("high")
    ends = ends.select(
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    limits = ends.select(F.struct("low", "high").alias("ends")).scalar()

    def edge(index: Column) -> Column:
        low, high = F.col("ends.low"), F.col("ends.high")
        step = (high - low) / F.lit(float(bins))
        return F.when(index == bins, high).otherwise(low + index.cast("double") * step)

    share = (F.col("v") - F.col("ends.low")) / (F.col("ends.high") - F.col("ends.low"))
    guess = F.least(F.floor(share * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    bin_ = F.col("bin")
    counted = (
        known.withColumn("ends", limits)
        .withColumn("bin", guess)
        .withColumn(
            "bin",
            F.when(F.col("v") < edge(bin_), bin_ - 1)
            .when((F.col("v") >= edge(bin_ + 1)) & (bin_ < bins - 1), bin_ + 1)
            .otherwise(bin_),
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = (
        ends.select(F.struct("low", "high").alias("ends"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .select("bin", edge(bin_).alias("low"), edge(bin_ + 1).alias("high"))
    )
    return (
        frame.join(counted, "bin", "left")
        .select(
            "bin",
            "low",
            "high",
            value_range(F.col("low"), F.col("high")).alias("label"),
            F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def clv_tiers(df: DataFrame, value: str, raise_on_ties: bool = False, tier: str = "clv_tier") -> DataFrame:
    """Quartile tiers: edges belong to the lower tier, the minimum to the lowest.

    Coinciding edges leave tiers empty, or raise when `raise_on_ties` is set.
    """
    edges = exact_quantiles(df, value, [0.0, *QUARTILES, 1.0])["q"]
    if raise_on_ties and len(set(edges)) < len(edges):
        raise ValueError(f"{value}: quartile edges coincide")
    inner = edges[1:-1]
    number = F.col(value).cast("double")
    name = F.when(number.isNull() | F.isnan(number), F.lit(None).cast("string"))
    rank = F.when(number.isNull() | F.isnan(number), F.lit(None).cast("int"))
    for i, edge in enumerate(inner):
        if edge is not None:
            name, rank = name.when(number <= F.lit(edge), F.lit(TIERS[i])), rank.when(number <= F.lit(edge), F.lit(i))
    last = len(TIERS) - 1
    return df.withColumns({tier: name.otherwise(F.lit(TIERS[last])), f"{tier}_rank": rank.otherwise(F.lit(last))})


def tier_summary(df: DataFrame, value: str, tier: str = "clv_tier") -> DataFrame:
    """Households and mean value per tier."""
    return df.groupBy(tier).agg(F.count(F.lit(1)).alias("households"), F.avg(value).alias("avg_clv"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """All four cells of a binary confusion matrix, empty ones with 0."""
    truth, guess = F.col(label).cast("int"), F.col(prediction).cast("int")
    cells = {(t, g): F.count_if((truth == t) & (guess == g)) for t in (0, 1) for g in (0, 1)}
    row = df.agg(*[cell.alias(f"n{t}{g}") for (t, g), cell in cells.items()])
    entries = [
        F.struct(F.lit(t).alias("label"), F.lit(g).alias("prediction"), F.col(f"n{t}{g}").alias("count"))
        for t, g in cells
    ]
    return row.select(F.inline(F.array(*entries)))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, and their averages.

    Divisions by zero give 0. The accuracy row carries the accuracy in all three
    measures and the number of rows as support.
    """
    cell = {(t, g): F.max(F.when((F.col("label") == t) & (F.col("prediction") == g), F.col("count"))) for t in (0, 1) for g in (0, 1)}
    n = confusion_matrix(df, label, prediction).agg(
        *[c.cast("double").alias(f"n{t}{g}") for (t, g), c in cell.items()]
    )
    columns = {}
    for c in (0, 1):
        other = 1 - c
        hits = F.col(f"n{c}{c}")
        columns[f"precision{c}"] = _share(hits, hits + F.col(f"n{other}{c}"))
        columns[f"recall{c}"] = _share(hits, hits + F.col(f"n{c}{other}"))
        columns[f"support{c}"] = hits + F.col(f"n{c}{other}")
    n = n.withColumns(columns)
    n = n.withColumns(
        {
            f"f1{c}": _share(
                F.lit(2.0) * F.col(f"precision{c}") * F.col(f"recall{c}"), F.col(f"precision{c}") + F.col(f"recall{c}")
            )
            for c in (0, 1)
        }
    )
    total = F.col("support0") + F.col("support1")
    accuracy = _share(F.col("n00") + F.col("n11"), total)

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / F.lit(2.0)

    def weighted(m: str) -> Column:
        return _share(F.col(f"{m}0") * F.col("support0") + F.col(f"{m}1") * F.col("support1"), total)

    measures = ("precision", "recall", "f1")
    lines = [line(str(c), *[F.col(f"{m}{c}") for m in measures], F.col(f"support{c}")) for c in (0, 1)]
    lines.append(line("accuracy", accuracy, accuracy, accuracy, total))
    lines.append(line("macro avg", *[macro(m) for m in measures], total))
    lines.append(line("weighted avg", *[weighted(m) for m in measures], total))
    return n.select(F.inline(F.array(*lines)))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def roc_auc(df: DataFrame, label: str, score: str, ranges: int | None = None) -> DataFrame:
    """One row: the exact area under the ROC curve; equal scores count half.

    Null when the labels are all alike.
    """
    positive = (F.col(label).cast("int") == 1).cast("bigint")
    counts = stage(value_totals(df, score, {"positives": positive, "negatives": F.lit(1).cast("bigint") - positive}))
    if counts.isEmpty():
        return df.sparkSession.createDataFrame([(None,)], "auc double")
    ranked = running_totals(counts, ["positives", "negatives"], ranges)
    won = F.col("positives").cast("double") * (
        F.col("before_negatives").cast("double") + F.col("negatives").cast("double") / 2
    )
    return ranked.agg(
        F.try_divide(F.sum(won), F.sum("positives").cast("double") * F.sum("negatives").cast("double")).alias("auc")
    )


def roc_auc_binned(df: DataFrame, label: str, score: str, bins: int = AUC_BINS) -> DataFrame:
    """One row: the area under the ROC curve in memory of `bins` counters, and how far it may be off.

    The range of the scores is cut into equal bins; positives and negatives of one bin
    count half, so each such pair of different scores is wrong by half at most: `bound`.
    Null and NaN scores are left out. Null when the labels are all alike.
    """
    number = F.col(score).cast("double")
    known = df.where(number.isNotNull() & ~F.isnan(number)).select(number.alias("score"), (F.col(label).cast("int") == 1).cast("bigint").alias("positive"))
    ends = known.agg(F.struct(F.min("score").alias("low"), F.max("score").alias("high")).alias("ends")).scalar()
    share = F.try_divide(F.col("score") - F.col("ends.low"), F.col("ends.high") - F.col("ends.low"))
    place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    counted = known.withColumn("ends", ends).groupBy(place).agg(
        F.sum("positive").alias("p"), F.sum(F.lit(1).cast("bigint") - F.col("positive")).alias("n")
    )
    # At most `bins` rows.
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("below", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    tied = F.col("p").cast("double") * F.col("n").cast("double") / 2
    pairs = F.sum("p").cast("double") * F.sum("n").cast("double")
    return ranked.agg(
        F.try_divide(F.sum(F.col("p").cast("double") * F.col("below").cast("double") + tied), pairs).alias("auc"),
        F.try_divide(F.sum(tied), pairs).alias("bound"),
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: mean squared, root mean squared and mean absolute error, and R²."""
    truth, guess = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = truth - guess
    return (
        df.where(truth.isNotNull() & guess.isNotNull())
        .agg(
            F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(truth).alias("variance")
        )
        .select(
            "mse",
            F.sqrt("mse").alias("rmse"),
            "mae",
            (F.lit(1.0) - F.try_divide(F.col("mse"), F.col("variance"))).alias("r2"),
        )
    )


def numeric_features(df: DataFrame, except_: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in except_]
