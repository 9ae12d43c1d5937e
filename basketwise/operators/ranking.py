"""Global order statistics without a global sort in one task.

Values are first counted per distinct value, which takes the weight out of ties,
then cut into ranges. Only the totals of the ranges are summed up in one place;
each range is then ordered on its own. The cuts decide how even the ranges are and
never the result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.session import stage

FEWEST_RANGES, MOST_RANGES = 64, 1024


def _ranges(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, within bounds."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(partitions, FEWEST_RANGES), MOST_RANGES)


def value_totals(df: DataFrame, value: str, totals: Mapping[str, Column]) -> DataFrame:
    """One row per distinct non-null value (as double) with summed columns."""
    number = F.col(value).cast("double")
    return (
        df.select(number.alias("value"), *[c.alias(n) for n, c in totals.items()])
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("value")
        .agg(*[F.sum(n).alias(n) for n in totals])
    )


def running_totals(df: DataFrame, names: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add before_<name> to a frame of distinct values: the sum over all smaller values.

    `df` is read several times and should be a stored frame.
    """
    ranges = ranges or _ranges(df)
    cuts = QuantileDiscretizer(
        numBuckets=ranges, inputCol="value", outputCol="range", relativeError=0.5 / ranges, handleInvalid="keep"
    )
    ranged = cuts.fit(df).transform(df)
    # At most `ranges` rows, so one task may hold them and every task may get them.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("range")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select("range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"offset_{n}") for n in names])
    )
    smaller = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = [
        (F.coalesce(F.sum(n).over(smaller), F.lit(0)) + F.col(f"offset_{n}")).alias(f"before_{n}") for n in names
    ]
    return ranged.join(F.broadcast(offsets), "range").select("value", *names, *before)


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], ranges: int | None = None
) -> dict[str, list]:
    """Exact quantiles with linear interpolation: {"p": [...], "q": [...], "n": [count]}.

    Null and NaN values are ignored; without any value every quantile is None.
    """
    counts = stage(value_totals(df, value, {"n": F.lit(1).cast("bigint")}))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if total == 0:
        return {"p": list(probabilities), "q": [None] * len(probabilities), "n": [0]}
    places = [p * (total - 1) for p in probabilities]
    needed = sorted({k for place in places for k in (math.floor(place), math.ceil(place))})
    ranked = running_totals(counts, ["n"], ranges)

    def at(rank: int) -> Column:
        holds = (F.col("before_n") <= rank) & (F.col("before_n") + F.col("n") > rank)
        return F.max(F.when(holds, F.col("value"))).alias(f"r{rank}")

    found = ranked.agg(*[at(rank) for rank in needed]).first()
    result = []
    for place in places:
        low, high = found[f"r{math.floor(place)}"], found[f"r{math.ceil(place)}"]
        result.append(low + (high - low) * (place - math.floor(place)))
    return {"p": list(probabilities), "q": result, "n": [total]}


def quantile_frame(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles as rows (probability, quantile)."""
    found = exact_quantiles(df, value, probabilities)
    return df.sparkSession.createDataFrame(
        list(zip(found["p"], found["q"])), "probability double, quantile double"
    )
