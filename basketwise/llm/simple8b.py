"""Token ids in Simple-8b words, written as files of segments and read back.

A 64-bit word holds a selector in its top 4 bits and as many equally wide ids in the
other 60 as fit. Selector 0 is an escape: the next word is one id that needs more than
60 bits. Ids are coded in blocks of 256; the offsets of the blocks' words let a reader
decode all blocks of a segment at once, or one block alone.

A file is Parquet, so that Spark commits whole files only and any store serves them. A
row is a segment: whole documents in ascending doc_id order, closed at 65,536 ids. Its
columns: `part` and `segment` (order), `first` (ids of the part before it), `doc_ids`,
`n_tokens`, `words` (little-endian 64-bit words), `blocks` (little-endian 32-bit
offsets of the blocks in the words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketwise.llm.text import in_batches, text_or_empty
from basketwise.llm.tokens import encoder

# Fixed values of the format: ids in a word, for selectors 2 to 15; each has 60 // count bits.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
# Ids that a word takes, by how many of the counts fit; an id too wide for any is escaped.
TAKEN = np.concatenate(([1], COUNTS[::-1]))
FIRST_SELECTOR = 2
ESCAPE = 0
PAYLOAD_BITS = 60
BLOCK = 256
SEGMENT_IDS = 65_536

SEGMENTS = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int64()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("words", pa.binary()),
        ("blocks", pa.binary()),
    ]
)
SEGMENTS_DDL = "part int, segment long, first long, doc_ids array<long>, n_tokens array<long>, words binary, blocks binary"


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; from 2^53 on at most one too many."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets of each block's words and their end) of unsigned 64-bit ids."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    most = int(COUNTS[0])
    grid = np.zeros((blocks, BLOCK + most), np.uint64)
    filled = np.zeros(blocks * BLOCK, np.uint64)
    filled[: len(ids)] = ids
    grid[:, :BLOCK] = filled.reshape(blocks, BLOCK)
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = len(ids) - (blocks - 1) * BLOCK
    # From every place, how many of the counts fit, smallest first; the largest is taken.
    widest = _widths(grid)
    window, span = widest, 1
    choice = np.zeros((blocks, BLOCK), np.int8)
    for count in COUNTS[::-1]:
        while span < count:
            step = min(span, int(count) - span)
            shifted = np.zeros_like(window)
            shifted[:, :-step] = window[:, step:]
            window, span = np.maximum(window, shifted), span + step
        choice += window[:, :BLOCK] <= PAYLOAD_BITS // count
    # All blocks step from word to word together; the words are built afterwards, all of a selector at once.
    rows, place, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(rows):
        at = place[rows]
        fit = choice[rows, at]
        steps.append((rows, at, fit))
        place[rows] = at + TAKEN[fit]
        rows = rows[place[rows] < sizes[rows]]
    owner, at, fit = (np.concatenate(column) for column in zip(*steps))
    order = np.argsort(owner, kind="stable")
    owner, fit = owner[order], fit[order]
    first = owner * (BLOCK + most) + at[order]
    lengths = np.where(fit == 0, 2, 1)
    slots = np.cumsum(lengths) - lengths
    words, flat = np.zeros(int(lengths.sum()), np.uint64), grid.reshape(-1)
    words[slots[fit == 0] + 1] = flat[first[fit == 0]]
    for k in np.unique(fit[fit > 0]):
        here, count = fit == k, int(TAKEN[k])
        width = np.uint64(PAYLOAD_BITS // count)
        word = np.full(int(here.sum()), (FIRST_SELECTOR + len(COUNTS) - int(k)) << PAYLOAD_BITS, np.uint64)
        for j in range(count):
            word |= flat[first[here] + j] << (np.uint64(j) * width)
        words[slots[here]] = word
    ends = np.cumsum(np.bincount(owner, lengths, blocks).astype(np.int64))
    return words, np.concatenate(([0], ends)).astype(np.uint32)


def decode(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The n ids of `encode`, all blocks at once."""
    ids = np.zeros(n, np.uint64)
    if not n:
        return ids
    selectors = (words >> np.uint64(PAYLOAD_BITS)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for place in np.flatnonzero(selectors == ESCAPE):  # only ids over 60 bits
        if not raw[place]:
            raw[place + 1] = True
    marker = (selectors == ESCAPE) & ~raw
    counts = np.where(raw, 1, np.where(marker, 0, COUNTS[np.maximum(selectors, FIRST_SELECTOR) - FIRST_SELECTOR]))
    before = np.concatenate(([0], np.cumsum(counts)))
    block = np.repeat(np.arange(len(blocks) - 1), np.diff(blocks.astype(np.int64)))
    place = before[:-1] - before[blocks[:-1].astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    ids[place[raw]] = words[raw]
    for k in np.unique(selectors[~raw & ~marker]):
        at = np.flatnonzero((selectors == k) & ~raw)
        count = int(COUNTS[k - FIRST_SELECTOR])
        width = PAYLOAD_BITS // count
        mask = np.uint64((1 << width) - 1)
        for j in range(count):
            inside = place[at] + j < end[at]
            ids[place[at][inside] + j] = (words[at][inside] >> np.uint64(j * width)) & mask
    return ids


def _segments(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer_path).encode
        part, segment, first, held, numbers = 0, 0, 0, [], []

        def close():
            nonlocal segment, first, held, numbers
            sizes = [len(ids) for ids in held]
            words, blocks = encode(np.concatenate(held))
            row = [[part], [segment], [first], [numbers], [sizes], [words.tobytes()], [blocks.tobytes()]]
            segment, first, held, numbers = segment + 1, first + sum(sizes), [], []
            return pa.record_batch([pa.array(v, t.type) for v, t in zip(row, SEGMENTS)], schema=SEGMENTS)

        size = 0
        for batch in batches:
            parts = batch.column("part").to_pylist()
            for number, part_of, ids in zip(batch.column("doc_id").to_pylist(), parts, encode_texts(batch.column("text"))):
                part = part_of
                held.append(np.append(ids, np.uint32(end_id)))
                numbers.append(number)
                size += len(ids) + 1
                if size >= SEGMENT_IDS:
                    yield close()
                    size = 0
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, parts: int | None = None) -> None:
    """Encode every text, append `end_id` and write the files of this format to the folder `path`.

    `docs` has doc_id and text; other columns are not read. Null texts are empty and
    give the end id alone. Rows without a doc_id come first; rows that repeat a doc_id
    are all written. An empty table writes no segment. A document is never cut: a
    segment of one longer than 65,536 ids is as long as it. A folder that exists is
    refused.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    ordered.transform(in_batches).mapInArrow(_segments(tokenizer_path, end_id), SEGMENTS_DDL).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.array(row["n_tokens"])
            ids = decode(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["blocks"], np.uint32), int(sizes.sum()))
            ids = ids.astype("<u4")
            ends = np.cumsum(sizes)
            yield pa.record_batch(
                [
                    pa.array([row["part"]] * len(sizes), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first"] + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(ends - sizes, ends)], pa.binary()),
                ],
                names=["part", "doc_id", "within", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: ids as little-endian unsigned 32-bit words.

    `start` is the number of ids of all documents before it. Only the totals of the
    parts, one row each, are summed up in one place.
    """
    segments = spark.read.schema(SEGMENTS_DDL).parquet(path)
    totals = segments.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rows = segments.transform(in_batches).mapInArrow(_documents, "part int, doc_id long, within long, n_tokens long, ids binary")
    return rows.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids"
    )
