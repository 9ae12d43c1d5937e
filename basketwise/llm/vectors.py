"""Embedding vectors as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64
# Sums of squares and products of vectors of up to 1,024 such components stay whole 64-bit numbers.
LARGEST = 1 << 24
WHOLE = "vec_id long, vector array<int>"


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector takes part: not null, every component finite and within LARGEST after scaling, `size` of them if given."""
    fits = vector.isNotNull() & F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) * SCALE <= LARGEST), F.lit(False))
    )
    return F.coalesce(fits, F.lit(False)) if size is None else F.coalesce(fits & (F.size(vector) == size), F.lit(False))


def whole_vectors(embeddings: DataFrame, size: int | None = None, column: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the usable rows, each component x as floor(64 * x) with x as double."""
    vector = F.col(column).cast("array<double>")
    whole = F.transform(vector, lambda x: F.floor(x * SCALE).cast("int"))
    return embeddings.where(usable(vector, size)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """The rows of a list column as one matrix; shorter rows are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy().astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    found = np.zeros((len(lengths), width), np.int64)
    found[np.arange(width) < lengths[:, None]] = values
    return found
