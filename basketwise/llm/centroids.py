"""Centroid clustering by an equal-average equal-variance search.

Centroids are sorted by the sum of their components. A vector's search starts at the
centroid of the nearest sum and goes outward. For D components, sums s and deviations
w = sqrt(D * sum of squares - s * s), the squared distance d of a vector and a centroid obeys

    D * d >= (difference of s)^2 + (difference of w)^2.

The sums alone end the scan: all centroids further out differ more. The deviations reject
single centroids. What is left gets its exact distance in whole numbers, so results are
those of comparing everything, ties included (the smaller number wins).

Vectors are read in Arrow batches; a round sends k * D sums of each task to one small
aggregation, and only the k centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.vectors import matrix
from basketwise.session import stage

CLUSTERS, ROUNDS, COMPONENTS = 16, 3, 64
# The deviations are floating-point numbers; the bound is lowered by more than their error.
SAFE = 1 - 1e-9
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass
class Search:
    """Centroids ready to be searched; `evaluated` counts exact distances."""

    centroids: np.ndarray
    evaluated: int = 0

    def __post_init__(self) -> None:
        self.sums, self.deviations = _sums(self.centroids)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row."""
        size = vectors.shape[1]
        sums, deviations = _sums(vectors)
        gaps = sums[:, None] - self.sums[None, :]
        outward = np.argsort(np.abs(gaps), axis=1, kind="stable")
        rows = np.arange(len(vectors))
        best = outward[:, 0].copy()
        distance = self._distances(vectors, best)
        for step in range(1, len(self.centroids)):
            number = outward[rows, step]
            bound = gaps[rows, number] ** 2
            near = bound <= size * distance[rows]
            rows, number, bound = rows[near], number[near], bound[near]
            if not len(rows):
                break
            spread = (deviations[rows] - self.deviations[number]) ** 2
            left = (bound + spread) * SAFE - 1 <= size * distance[rows]
            tried, number = rows[left], number[left]
            found = self._distances(vectors[tried], number)
            better = (found < distance[tried]) | ((found == distance[tried]) & (number < best[tried]))
            best[tried[better]], distance[tried[better]] = number[better], found[better]
        return best, distance

    def _distances(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        self.evaluated += len(vectors)
        apart = vectors - self.centroids[numbers]
        return np.einsum("ij,ij->i", apart, apart)


def _sums(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = vectors.sum(axis=1)
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return sums, np.sqrt(np.maximum(vectors.shape[1] * squares - sums * sums, 0).astype(float))


def first_centroids(points: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose text `1:<vec_id>` has the smallest SHA-256, in that order; rows without vec_id come last."""
    ordered = points.withColumn("place", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    chosen = ordered.orderBy(F.asc_nulls_last("place"), "vector").limit(clusters).collect()
    return np.array([row["vector"] for row in chosen], np.int64)


def next_centroids(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the components' means over the vectors nearest to each centroid; a centroid without any stays."""
    search = points.sparkSession.sparkContext.broadcast(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Search(search.value)
        sums = np.zeros_like(finder.centroids)
        counts = np.zeros(len(sums), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column("vector"))
                numbers, _ = finder.nearest(vectors)
                counts += np.bincount(numbers, minlength=len(sums))
                for number in np.unique(numbers):
                    sums[number] += vectors[numbers == number].sum(axis=0)
        used = np.flatnonzero(counts)
        size = sums.shape[1]
        columns = [np.repeat(used, size).astype(np.int32), np.tile(np.arange(size, dtype=np.int32), len(used))]
        columns += [sums[used].reshape(-1), np.repeat(counts[used], size)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["cluster", "place", "total", "n"])

    parts = points.select("vector").mapInArrow(add, "cluster int, place int, total long, n long")
    # One row for each component of each centroid.
    means = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    moved = centroids.copy()
    for row in means:
        moved[row["cluster"], row["place"]] = row["total"] // row["n"]
    return moved


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    search = points.sparkSession.sparkContext.broadcast(centroids)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Search(search.value)
        for batch in batches:
            if batch.num_rows:
                numbers, distance = finder.nearest(matrix(batch.column("vector")))
                yield pa.record_batch(
                    [batch.column("vec_id"), pa.array(numbers.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    return points.select("vec_id", "vector").mapInArrow(find, "vec_id long, cluster int, distance long")


def clusters_of(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Cluster, squared distance, inertias and centroid digest of every vector after `rounds` rounds.

    `points` has vec_id and vector, whole numbers, all vectors of one length; other columns
    are not read. Equal vectors get equal clusters; a repeated row is reported each time,
    as is one without vec_id. With fewer vectors than `clusters` there are as many
    centroids as vectors; an empty table gives an empty result.
    """
    spark = points.sparkSession
    points = stage(points.select("vec_id", "vector"))
    centroids = first_centroids(points, clusters)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = next_centroids(points, centroids)
    found = stage(assigned(points, centroids))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    # A row for each cluster.
    totals = stage(found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")))
    inertia = totals.agg(F.sum("cluster_inertia")).first()[0]
    return (
        found.join(F.broadcast(totals.join(named, "cluster")), "cluster")
        .withColumn("inertia", F.lit(inertia).cast("long"))
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )
