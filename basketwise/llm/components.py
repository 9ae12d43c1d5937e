"""Connected components of an edge table, by repeated joins on stored frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.operators.skew import join_spread
from basketwise.session import BROADCAST_ROWS, release, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node of `edges` (a, b).

    Every round links each node's larger neighbours to its smallest one, then its
    smaller neighbours, which halves long chains; rounds end when nothing changes.
    A hub keeps one row per neighbour, is combined before its shuffle, and learns of its
    smallest neighbour by a join that spreads its rows. Self-loops, repeated and reversed
    edges change nothing; rows with a null end are left out.
    """
    linked = edges.select("a", "b").where("a <> b")
    stars = stage(linked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(stars)

    def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
        # Few edges need no care, and no counts of their own.
        return rows.join(table, "a") if state[0] <= BROADCAST_ROWS else join_spread(rows, table, ["a"], "inner")

    while True:
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = joined(both.where("b > a"), lowest).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = stage(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = joined(large, least).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        old = stars
        stars = stage(small.unionAll(least.select("a", F.col("low").alias("b"))).distinct())
        release(large, old)
        before, state = state, _state(stars)
        if state == before:
            break
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(stars: DataFrame) -> tuple:
    """Count and hash sum of a stored set of edges."""
    parts = F.xxhash64("a", "b")
    return tuple(stars.agg(F.count("*"), F.sum(parts % 1_000_003), F.bit_xor(parts)).first())
