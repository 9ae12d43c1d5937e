"""Exact top-k search by inner product over an impact-ordered index, a score at a time.

The vectors are dealt into shards of a few thousand. The impact of a component is its
absolute value, quantised to powers of two. A shard's index has a posting segment for
every class of impacts and every component: the values of that class. Embeddings have no
absent components, so a segment is a row of as many places as there are entries, and all
segments of a class make a matrix. Classes are processed by descending impact: the
segments of a class, times the queries' components, are added to the accumulators of a
block of queries at once.

What the classes to come can still add to an entry is bounded by the lengths (stored in
the index) of the part of the vector not yet seen and of the query. Entries that cannot
reach the k-th best lower bound are out: that is the proof. Once it costs less to score
a query's possible members exactly than to go on, they are, in whole numbers. Equal
vectors are one entry of the index, so copies in any number cost as much as one.

Queries come in batches of bounded bytes, sent to all tasks; a shard answers each with
its best k rows, and the best k of all shards are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketwise.llm.vectors import matrix
from basketwise.session import stage

BEST = 20
SHARD_ROWS = 4_096
BLOCK = 256
QUERY_BYTES = 16 << 20
# An entry scored exactly costs as much as so many in the product of a class.
EXACT_COST = 8
# Bounds are floating-point numbers and are widened by more than their error.
ROOM = 1 + 1e-4
# Orders rows without vec_id behind all others.
NO_ID = np.iinfo(np.int64).max
FOUND = "query_row long, query_id long, row long, vec_id long, score long"


class ImpactIndex:
    """Segments of the distinct vectors of a shard, and the rows that have them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.vectors, entry = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((rows, ids, entry.reshape(-1)))
        self.rows, self.ids = rows[order], ids[order]
        self.starts = np.searchsorted(entry.reshape(-1)[order], np.arange(len(self.vectors) + 1))
        self.size = self.vectors.shape[1]
        sizes = np.abs(self.vectors)
        self.peak = int(sizes.max(initial=0))
        # Whole numbers below 2^24 are exact in four bytes.
        self.exact = np.float32 if self.size * self.peak * self.peak < 1 << 24 else np.float64
        impact = np.frexp(sizes.astype(float))[1]
        self.classes = []
        for number in range(self.peak.bit_length(), 0, -1):
            segments = np.where(impact == number, self.vectors, 0).T.astype(self.exact)
            later = np.where(impact < number, sizes, 0).astype(float)
            self.classes.append((segments, np.sqrt((later * later).sum(axis=1)), later.sum(axis=1), later.max(initial=0)))
        self.products = self.rescored = 0

    def search(self, queries: np.ndarray, own_rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each query its number and the rows, ids and scores of the shard's best k rows but its own, ties to smaller ids."""
        count = len(self.vectors)
        asked = np.zeros((len(queries), self.size), np.int64)
        width = min(self.size, queries.shape[1])
        asked[:, :width] = queries[:, :width]
        kind = self.exact if self.size * self.peak * int(np.abs(asked).max(initial=0)) < 1 << 24 else np.float64
        weights = asked.astype(kind)
        lengths = np.abs(asked).astype(float)
        lengths = np.sqrt((lengths * lengths).sum(axis=1)), lengths.max(axis=1, initial=0), lengths.sum(axis=1)
        # Sums beyond 2^53 are rounded.
        error = lengths[2] * self.peak * 1e-12
        left = np.arange(len(asked))
        totals = np.zeros((len(asked), count), kind)
        for step, (segments, straight, along, largest) in enumerate(self.classes):
            totals += weights[left] @ segments
            self.products += len(left) * count
            room = np.minimum(lengths[0][left, None] * straight, lengths[1][left, None] * along)
            room = np.minimum(room, lengths[2][left, None] * largest) * ROOM + error[left, None]
            if count > k:
                bound = np.partition(totals - room, count - k - 1, axis=1)[:, count - k - 1 : count - k]
                possible = totals + room >= bound
            else:
                possible = np.ones((len(left), count), bool)
            to_come = len(self.classes) - step - 1
            done = possible.sum(axis=1) * EXACT_COST <= to_come * count if to_come else np.ones(len(left), bool)
            for place in np.flatnonzero(done):
                number = left[place]
                yield number, *self._exact(asked[number], np.flatnonzero(possible[place]), own_rows[number], k)
            left, totals = left[~done], totals[~done]
            if not len(left):
                return
        for number in left:  # all vectors are zero
            yield number, *self._exact(asked[number], np.arange(count), own_rows[number], k)

    def _exact(self, query: np.ndarray, possible: np.ndarray, own_row: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.rescored += len(possible)
        scores = self.vectors[possible] @ query
        if len(possible) > k + 1:
            least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            possible, scores = possible[scores >= least], scores[scores >= least]
        # Of equal vectors, k + 1 rows suffice, the query's own among them.
        lengths = np.minimum(self.starts[possible + 1] - self.starts[possible], k + 1)
        members = np.repeat(self.starts[possible] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        scores = np.repeat(scores, lengths)
        other = self.rows[members] != own_row
        members, scores = members[other], scores[other]
        best = np.lexsort((self.rows[members], self.ids[members], -scores))[:k]
        return self.rows[members[best]], self.ids[members[best]], scores[best]


def _search_shards(queries, k: int, shard_rows: int):
    """The best rows of each shard, of at most `shard_rows` rows of a task, for every query of the batch."""

    def answers(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(parts)
        ids = held.column("vec_id").fill_null(NO_ID).to_numpy()
        index = ImpactIndex(held.column("row").to_numpy(), ids, matrix(held.column("vector")))
        asked_rows, asked_ids, asked = queries.value
        for first in range(0, len(asked), BLOCK):
            columns = [[], [], [], [], []]
            own = asked_rows[first : first + BLOCK]
            for number, rows, ids, scores in index.search(asked[first : first + BLOCK], own, k):
                found = (np.full(len(rows), own[number]), np.full(len(rows), asked_ids[first + number]), rows, ids, scores)
                for column, values in zip(columns, found):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c), pa.int64()) for c in columns]
            unknown = np.concatenate(columns[3]) == NO_ID
            arrays[3] = pa.array(np.concatenate(columns[3]), pa.int64(), mask=unknown)
            yield pa.record_batch(arrays, names=["query_row", "query_id", "row", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shard_rows - held)
                batch = batch.slice(part.num_rows)
                parts.append(part)
                held += part.num_rows
                if held == shard_rows:
                    yield from answers(parts)
                    parts, held = [], 0
        if parts:
            yield from answers(parts)

    return run


def best_matches(vectors: DataFrame, wanted, k: int = BEST, shard_rows: int = SHARD_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `wanted` (a condition on vec_id) chooses its best k other rows.

    `vectors` has vec_id and vector, whole numbers; other columns are not read. The score
    is the inner product; a shorter vector counts as filled up with zeros. Ties go to the
    smaller vec_id, rows without vec_id last. Every row stands for itself: a repeated row
    is a candidate of its copies, and a repeated query is answered once for each copy. With fewer
    than k other rows all are given. No rows or no queries give an empty result.
    """
    spark = vectors.sparkSession
    # The number of a row is fixed by the stored copy.
    rows = stage(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"))
    asked = rows.where(wanted)
    sizes = asked.agg(F.count("*").alias("n"), F.sum(F.size("vector")).alias("components")).first()
    shards = max(1, -(-rows.count() // shard_rows))
    # Dealt evenly, whatever the keys are.
    dealt = rows.repartition(shards)
    batches = max(1, -(-8 * (sizes["components"] or 0) // query_bytes))
    found = []
    for number in range(batches if sizes["n"] else 0):
        # At most about `query_bytes`.
        batch = asked.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == number).orderBy("row").toArrow()
        query = spark.sparkContext.broadcast(
            (batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("vector")))
        )
        part = stage(dealt.mapInArrow(_search_shards(query, k, shard_rows), FOUND))
        found.append(_best(part, k))
        query.unpersist()
    result = found[0] if found else _best(spark.createDataFrame([], FOUND), k)
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
