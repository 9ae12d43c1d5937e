"""Aggregation of transaction lines by attributes of a dimension table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.session import BROADCAST_ROWS, fits_broadcast


def sum_by_dimension(
    lines: DataFrame,
    dimension: DataFrame,
    key: str,
    by: Sequence[str],
    measures: Mapping[str, Column],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Sum `measures` over the joined lines, grouped by columns of either side.

    A dimension of checked size is broadcast, and only group totals are shuffled.
    A larger one is joined after the lines have been summed per key, so a key that
    holds a large share of the lines reaches the join as a few rows.
    """
    attributes = [c for c in by if c in dimension.columns and c != key]
    line_columns = [c for c in by if c not in attributes]
    dimension = dimension.select(key, *attributes)
    lines = lines.select(*dict.fromkeys([key, *line_columns]), *[m.alias(n) for n, m in measures.items()])
    totals = [F.sum(name).alias(name) for name in measures]
    if fits_broadcast(dimension, broadcast_rows):
        return lines.join(F.broadcast(dimension), key, how).groupBy(*by).agg(*totals)
    partial = lines.groupBy(*dict.fromkeys([key, *line_columns])).agg(*totals)
    return partial.join(dimension, key, how).groupBy(*by).agg(*totals)
