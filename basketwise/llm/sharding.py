"""Shards of near equal bytes by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts are one group and stay together. Groups sorted by size,
largest first, enter the bin with the least room that still holds them, found in a
balanced tree of the bins by room. Groups of one size are alike, so the packing works
on how many groups there are of each size class: a class is placed bin by bin. For a
given capacity the classes are the exact sizes; of b bytes in all there are fewer than
the root of 2 b of them. For a given number of shards sizes keep 12 leading bits, rounded
up, so there are fewer than 2,048 classes for each doubling of size, and a bin's real
load is at most its planned one. The driver packs these counts only; groups get their
bins from their rank within the class, and that is counted in ranges, in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketwise.operators.skew import join_spread
from basketwise.session import stage

SHARDS = 8
LEADING_BITS = 12
# Members of a class or shard are numbered in ranges, this many or of about so many rows each.
RANGES, RANGE_ROWS = 64, 250_000
# Tries to find the least capacity that fits.
TRIES = 40


class BinTree:
    """Bins by room in a balanced tree (a treap): the tightest bin that holds a size, in logarithmic time."""

    def __init__(self):
        self.root, self.seed = None, 88_172_645_463_325_252

    def _priority(self) -> int:
        """Xorshift numbers keep the tree balanced for any order of inserts."""
        self.seed ^= (self.seed << 13) & (1 << 64) - 1
        self.seed ^= self.seed >> 7
        self.seed ^= (self.seed << 17) & (1 << 64) - 1
        return self.seed

    def _split(self, node, key):
        """Trees of the keys below `key` and of the others; a node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, room: int, name: int) -> None:
        low, high = self._split(self.root, (room, name))
        self.root = self._join(self._join(low, [(room, name), self._priority(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the least room that is at least `size`."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        room, name = node[0]
        _, rest = self._split(high, (room, name + 1))
        self.root = self._join(low, rest)
        return room, name


def best_fit_decreasing(classes: Sequence[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """Place classes (size, count), largest first: ([(size, bin, count)], bins used).

    A new bin is opened when no open one has room. A group larger than the capacity gets
    a bin of its own.
    """
    tree, used, placed = BinTree(), 0, []
    for size, count in sorted(classes, reverse=True):
        while count:
            found = tree.take(size)
            if found is None:
                room, name, used = max(capacity, size), used, used + 1
            else:
                room, name = found
            # The tightest bin stays the tightest until it is full.
            fits = min(count, room // size)
            placed.append((size, name, fits))
            tree.add(room - fits * size, name)
            count -= fits
    return placed, used


def even_bins(classes: Sequence[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best-fit decreasing into a given number of bins, at the least capacity found to fit.

    Groups larger than an even share get bins of their own, and the rest is shared by the
    other bins.
    """
    left, own = sorted(classes), []
    while left and bins - len(own) > 1:
        total = sum(size * count for size, count in left)
        size, count = left[-1]
        if size * (bins - len(own)) <= total:
            break
        own.append((size, len(own), 1))
        left[-1:] = [(size, count - 1)] if count > 1 else []
    rest = bins - len(own)
    if not left:
        return own
    total = sum(size * count for size, count in left)
    low, high = max(-(-total // rest), left[-1][0]), total
    best, _ = best_fit_decreasing(left, high)
    for _ in range(TRIES):
        if low >= high:
            break
        middle = (low + high) // 2
        placed, used = best_fit_decreasing(left, middle)
        if used <= rest:
            best, high = placed, middle
        else:
            low = middle + 1
    return own + [(size, len(own) + name, count) for size, name, count in best]


def size_class(size: Column) -> Column:
    """Sizes rounded up to LEADING_BITS leading bits."""
    unit = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - LEADING_BITS + 1, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), unit)
    return (F.ceil(size / step) * step).cast("long")


def numbered(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """A number from 0 within each key, without all rows of a key in one task.

    `df` should be a stored frame. The rows of a key are dealt to ranges by their hash,
    numbered there, and raised by the counts of the ranges before.
    """
    ranges = max(RANGES, -(-df.count() // RANGE_ROWS))
    placed = df.withColumn("range", F.pmod(F.xxhash64(*order), F.lit(ranges)).cast("int"))
    counts = placed.groupBy(key, "range").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(key, "range").orderBy(*order)) - 1
    ranked = placed.withColumn("inside", inside).join(offsets, [key, "range"])
    return ranked.withColumn(name, (F.col("inside") + F.col("before")).cast("long")).drop("range", "inside", "before")


def _assigned(groups: DataFrame, placed: list[tuple[int, int, int]]) -> DataFrame:
    """`groups` (group, class) with the shard of each, by their rank within the class."""
    spark = groups.sparkSession
    taken: dict[int, int] = {}
    rows = []
    for size, shard, count in placed:
        first = taken.get(size, 0)
        rows.append((size, shard, first, first + count))
        taken[size] = first + count
    plan = spark.createDataFrame(rows, "class long, shard int, first long, last long")
    ranked = numbered(groups, "class", ["group"], "rank")
    spans = plan.groupBy("class").agg(F.collect_list(F.struct("first", "last", "shard")).alias("spans"))
    found = join_spread(ranked, spans, ["class"], "inner")
    holds = F.filter("spans", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"]))
    return found.select("group", holds[0]["shard"].alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of `docs`.

    `size` is the text's UTF-8 bytes plus 1. With `capacity`, as few bins of that many
    bytes as best-fit decreasing finds; without, `shards` bins of near equal bytes. Rows
    of one text share a shard; null and empty texts are one text. A slot numbers the
    rows of a shard from 0. Rows that repeat or lack a doc_id are placed like others.
    Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    content = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.length(content) + 1).cast("long").alias("size"),
            F.crc32(content).alias("text_crc32"),
            F.unhex(F.sha2(content, 256)).alias("group"),
        )
    )
    size = F.col("bytes") if capacity else size_class(F.col("bytes"))
    groups = stage(rows.groupBy("group").agg(F.sum("size").alias("bytes")).select("group", size.alias("class")))
    classes = [(row["class"], row["count"]) for row in groups.groupBy("class").count().collect()]
    placed = best_fit_decreasing(classes, capacity)[0] if capacity else even_bins(classes, shards)
    chosen = _assigned(groups, placed)
    placed_rows = stage(rows.join(chosen, "group").select("doc_id", "size", "text_crc32", "shard"))
    return numbered(placed_rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
