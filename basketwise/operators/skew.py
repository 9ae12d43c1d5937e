"""Joins on keys that a large share of the rows may have.

A key with more than one in HEAVY of the rows is heavy; there are fewer than HEAVY of
them, whatever the number of rows. Their rows stay where they are and get the few rows of
the other side by a broadcast; all other rows are shuffled. Rows without a key match
nothing and take no part in a shuffle, in which they would all meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.session import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast

HEAVY = 200
COUNTERS = 4_096


def heavy_keys(rows: DataFrame, keys: Sequence[str], heavy: int = HEAVY) -> DataFrame | None:
    """The keys of more than one in `heavy` of the rows, or None; fewer than `heavy` rows.

    Rows are first counted by a hash of their key, COUNTERS counters in all; keys are counted
    only in counters that are large enough for a heavy one.
    """
    return heavy_keys_and_rows(rows, keys, heavy)[0]


def heavy_keys_and_rows(rows: DataFrame, keys: Sequence[str], heavy: int = HEAVY) -> tuple[DataFrame | None, int]:
    """`heavy_keys`, and the number of rows that have a key."""
    known = rows.dropna(subset=list(keys)).select(*keys)
    counter = F.pmod(F.xxhash64(*keys), F.lit(COUNTERS))
    counts = {r["counter"]: r["count"] for r in known.groupBy(counter.alias("counter")).count().collect()}
    total = sum(counts.values())
    large = [number for number, count in counts.items() if count * heavy > total]
    if not large:
        return None, total
    counted = known.where(counter.isin(large)).groupBy(*keys).count()
    found = counted.where(F.col("count") * heavy > total).select(*keys)
    held = found.collect()
    return (rows.sparkSession.createDataFrame(held, found.schema) if held else None), total


def join_spread(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    heavy: int = HEAVY,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`rows` joined with `table` on equal key columns: "left", "inner", "left_semi" or "left_anti".

    A table of few rows is sent to the rows whole. Otherwise the rows of heavy keys and
    the others go the ways of the module. `rows` is read up to four times and should be
    cheap to read.
    """
    keys = list(keys)
    if fits_broadcast(table, broadcast_rows, broadcast_bytes):
        return rows.join(F.broadcast(table), keys, how)
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    known = rows.where(complete)
    hot = heavy_keys(rows, keys, heavy)
    few = None if hot is None else table.join(F.broadcast(hot), keys, "left_semi")
    # A table may have any number of rows for a key.
    if few is not None and fits_broadcast(few, broadcast_rows, broadcast_bytes):
        alone = known.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how)
        result = alone.unionByName(known.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how))
    else:
        result = known.join(table, keys, how)
    if how in ("left", "left_anti"):
        result = result.unionByName(rows.where(~complete), allowMissingColumns=True)
    return result
