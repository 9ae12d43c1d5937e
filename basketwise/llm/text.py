"""Arrow text columns as byte arrays: words, 64-bit word hashes and shingle sets.

Everything works on slices of about a megabyte of whole documents, so memory is
bounded by the slice, or by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketwise.session import fits_broadcast, stage

SHINGLE = 5
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SLICE_BYTES = 1 << 20

# Words are runs of anything but space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.default_rng(20)
_odd = lambda *shape: _random.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES = _odd(256)
BASE = _odd(1)[0]
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACES = _odd(SHINGLE)
LENGTH_TAGS = _odd(SHINGLE + 1)
MIX = _odd(3)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def in_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session that hands whole texts to Python 1,000 rows at a time.

    Spark's default of 10,000 is meant for short rows; another setting is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS, "10000") == "10000":
        conf.set(BATCH_ROWS, "1000")
    return df


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not in the one column of `ids`.

    The ids are stored and counted. As many as a broadcast may have are sent to the
    texts where they lie; with more, both sides are shuffled.
    """
    name = "_".join(["gone", *docs.columns])
    gone = stage(ids.toDF(name).where(F.col(name).isNotNull()).distinct())
    gone = F.broadcast(gone) if fits_broadcast(gone) else gone
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def mix(values: np.ndarray, key: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(32))) * MIX[key]
    values = (values ^ (values >> np.uint64(29))) * MIX[2]
    return values ^ (values >> np.uint64(32))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for place, factor in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[place] = np.multiply.accumulate(steps)
    return _powers[0][:size], _powers[1][:size]


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        rows = offsets[first : end + 1]
        yield first, end, data[rows[0] : rows[-1]], rows - rows[0]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row."""
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of words by a rolling polynomial; `letters` maps bytes first."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[letters[data]] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def runs(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within each row, and the number of runs before each row."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    before = np.concatenate(([0], np.cumsum(counts)))
    if before[-1] == 0:
        return np.zeros(0, np.uint64), before
    span = len(hashes) - size + 1
    joined = hashes[:span] * PLACES[0]
    for k in range(1, size):
        joined = mix(joined) + hashes[k : k + span] * PLACES[k]
    places = np.arange(before[-1]) + np.repeat(offsets[:-1] - before[:-1], counts)
    return mix(joined[places] + LENGTH_TAGS[size], 1), before


def shingle_sets(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = LOWER) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its five-word shingles.

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    starts, ends, words = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends, letters)
    joined, before = runs(hashes, words, SHINGLE)
    counts = np.diff(words)
    sets = []
    for row, count in enumerate(counts):
        if count >= SHINGLE:
            sets.append(np.unique(joined[before[row] : before[row + 1]]))
        elif count:
            sets.append(runs(hashes[words[row] : words[row + 1]], np.array([0, count]), int(count))[0])
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
