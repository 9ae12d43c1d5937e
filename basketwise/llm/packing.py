"""Hierarchical multi-length packing of token sequences.

Documents are routed to the smallest context size, or tier, that holds them; of longer
ones full windows of the largest tier are cut off and the rest is routed. Each tier
packs its own windows. Gaps of a window are filled from shorter tiers, the largest
piece that fits first; when none fits, a document is cut to close the gap and its rest
goes back to its tier. Every window is therefore full. At the end of a partition the
rest, less than a few windows, is divided into full windows of falling tiers, and only
what is smaller than the smallest tier is padded.

A window belongs to a step group of equal token budget: the windows of one tier that
together have GROUP_TOKENS tokens.

Windows are packed within partitions, so no ids are shuffled; the padding is at most
one window for each partition.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.text import in_batches, text_or_empty
from basketwise.llm.tokens import encoder

TIERS = (256, 512, 1024, 2048)
GROUP_TOKENS = 16_384
# Documents held at once are packed when they have so many tokens.
HELD_TOKENS = 1 << 20
# Numbers of a partition's windows.
SEQUENCE_BITS = 33

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("tier", pa.int32()),
        ("step_group", pa.int64()),
        ("ids", pa.binary()),
    ]
)
PIECES_DDL = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
)


class Packer:
    """Packs the documents of one partition; `ready` has the pieces of finished windows."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.partition = partition
        self.pools: list[list] = [[] for _ in tiers]  # (length, order, document, start)
        self.held, self.order, self.windows = 0, 0, 0
        self.of_tier = [0] * len(tiers)
        self.groups = [(-1, 0)] * len(tiers)
        self.next_group = 0
        self.ready: list[tuple] = []

    def add(self, document: tuple, start: int = 0) -> None:
        """`document` is (doc_id, ids); routes what follows `start`."""
        length = len(document[1]) - start
        while length >= self.tiers[-1]:
            self._finish(len(self.tiers) - 1, [(self.tiers[-1], document, start)])
            start, length = start + self.tiers[-1], length - self.tiers[-1]
        if length:
            self.order += 1
            insort(self.pools[self._tier(length)], (length, self.order, document, start), key=lambda piece: piece[:2])
            self.held += length

    def _tier(self, length: int) -> int:
        return next(k for k, size in enumerate(self.tiers) if length <= size)

    def _take(self, tier: int, gap: int):
        """The largest piece of this tier or a shorter one that fits the gap."""
        for k in range(tier, -1, -1):
            place = bisect_right(self.pools[k], gap, key=lambda piece: piece[0])
            if place:
                return self.pools[k].pop(place - 1)
        return None

    def _cut(self, tier: int):
        """The shortest piece of the longest tier up to this one, else of any."""
        for k in [*range(tier, -1, -1), *range(tier + 1, len(self.tiers))]:
            if self.pools[k]:
                return self.pools[k].pop(0)
        return None

    def _window(self, tier: int) -> None:
        size, pieces = self.tiers[tier], []
        gap = size
        while gap:
            piece = self._take(tier, gap)
            if piece is None:
                piece = self._cut(tier)
            length, _, document, start = piece
            self.held -= length
            used = min(length, gap)
            pieces.append((used, document, start))
            gap -= used
            if used < length:
                self.add(document, start + used)
        self._finish(tier, pieces)

    def _finish(self, tier: int, pieces: list) -> None:
        group, left = self.groups[tier]
        if left < self.tiers[tier]:
            group, left = self.next_group, max(GROUP_TOKENS, self.tiers[tier])
            self.next_group += 1
        self.groups[tier] = (group, left - self.tiers[tier])
        sequence = (self.partition << SEQUENCE_BITS) | self.windows
        offset = 0
        for length, (doc_id, ids), start in pieces:
            self.ready.append(
                (
                    doc_id, start, length, len(ids), sequence, offset, self.tiers[tier],
                    (self.partition << SEQUENCE_BITS) | group, ids[start : start + length].tobytes(),
                )
            )
            offset += length
        self.windows += 1

    def pack(self, last: bool = False) -> None:
        """Fill windows from the longest tier down; at the end the rest too."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.pools[tier] and self.held >= self.tiers[tier]:
                self._window(tier)
        if last:
            for tier in range(len(self.tiers) - 1, -1, -1):
                while self.held >= self.tiers[tier]:
                    self._window(tier)
            rest = [(length, document, start) for pool in self.pools for length, _, document, start in pool]
            if rest:
                self.pools, self.held = [[] for _ in self.tiers], 0
                # Padded to the largest tier.
                self._finish(len(self.tiers) - 1, rest)


def _pack(tokenizer_path: str, end_id: int, tiers: tuple[int, ...]):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows), PIECES)], schema=PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer_path).encode
        packer, waiting = None, 0
        for batch in batches:
            parts = batch.column("part").to_pylist()
            for number, part, ids in zip(batch.column("doc_id").to_pylist(), parts, encode_texts(batch.column("text"))):
                packer = packer or Packer(part, tiers)
                packer.add((number, np.append(ids, np.uint32(end_id)).astype("<u4")))
                waiting += len(ids) + 1
                if waiting >= HELD_TOKENS:
                    packer.pack()
                    yield batch_of(packer.ready)
                    packer.ready, waiting = [], 0
        if packer:
            packer.pack(last=True)
            yield batch_of(packer.ready)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, tier, step_group, ids.

    `docs` has doc_id and text; other columns are not read. A null or empty text is a
    document of the end id alone. Documents of any length are cut into windows. Rows
    that repeat or lack a doc_id are packed like others. An empty table gives no rows.
    `ids` are little-endian unsigned 32-bit words. Numbers of sequences follow from the
    partitions of `docs`; a repeated task gives the same ones if its input is in the
    same order, as that of files is.
    """
    numbered = docs.select(
        F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.spark_partition_id().alias("part")
    )
    return numbered.transform(in_batches).mapInArrow(_pack(tokenizer_path, end_id, tiers), PIECES_DDL)
