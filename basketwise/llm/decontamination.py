"""Size-partitioned MinHash containment search of benchmark items in documents.

A whole long document and a short item have a Jaccard similarity near zero, so equal
bands of signatures of both would miss nearly all items. The signature is therefore
taken of the item alone: with n distinct shingles and a containment of at least t
wanted, a document may lack n - ceil(t n) of them, so it has at least one of the item's
n - ceil(t n) + 1 smallest shingle hashes (its k minimum values, with k by size). No
item is lost. Items are partitioned by size, in powers of two; a partition is searched
only with those shingles of a document whose hash is at most its largest minimum value,
a small share of all. What the signatures find is verified on the shingles' words.

Items are taken in blocks of bounded text, one at a time: a block is sent to one pass over
the documents, its matches are stored, and it is gone before the next is read. A block
holds the texts and signatures of its items; the shingles of an item are made when a
document may contain it. Signatures of the documents are never stored or moved.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.text import LOWER, SHINGLE, byte_slices, in_batches, runs, text_or_empty, without_ids, word_bounds, word_hashes
from basketwise.session import stage

# Containment in hundredths.
THRESHOLD = 80
# Text of a block of items; an item that is longer has a block of its own size.
BLOCK_BYTES = 32 << 20
# Items whose shingles a task keeps for the next documents.
KEPT = 1_000

MATCHES = "doc_id long, item_id long, shared long, item_shingles long"


def words_of(raw: bytes) -> list[bytes]:
    """Words with A-Z in lower case; bytes are split at blanks and the control characters 9 to 13."""
    return raw.lower().split()


def shingles_of(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


class ItemIndex:
    """Signatures of a block of items, by run length and size class."""

    def __init__(self, items: list[tuple[int, str]], threshold: int):
        self.threshold = threshold
        self.items = []  # (item_id, run length, text)
        self.kept: dict[int, set] = {}
        entries = defaultdict(list)
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, words = word_bounds(raw, np.array([0, len(raw)]))
            length = min(SHINGLE, len(starts))
            if not length:
                continue
            hashes, _ = runs(word_hashes(raw, starts, ends, LOWER), words, length)
            hashes = np.unique(hashes)
            signature = hashes[: len(hashes) - -(-threshold * len(hashes) // 100) + 1]
            entries[length, len(hashes).bit_length()] += [(h, len(self.items)) for h in signature.tolist()]
            self.items.append((item_id, length, text.encode()))
        self.tables = defaultdict(list)
        for (length, _), found in entries.items():
            found.sort()
            values = np.array([h for h, _ in found], np.uint64)
            self.tables[length].append((values, np.array([item for _, item in found])))

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, set[int]]:
        """Items with a signature value among the shingles of each row."""
        starts, ends, words = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends, LOWER)
        found = defaultdict(set)
        for length, tables in self.tables.items():
            joined, before = runs(hashes, words, length)
            for values, items in tables:
                low = np.flatnonzero(joined <= values[-1])
                first = np.searchsorted(values, joined[low], "left")
                hit = values[first] == joined[low]
                rows = np.searchsorted(before, low[hit], "right") - 1
                last = np.searchsorted(values, joined[low[hit]], "right")
                for row, a, b in set(zip(rows.tolist(), first[hit].tolist(), last.tolist())):
                    found[row].update(items[a:b].tolist())
        return found

    def matches(self, raw: bytes, candidates: set[int]) -> Iterator[tuple[int, int, int]]:
        """(item_id, shared, size) of the candidates that a text really contains."""
        words = words_of(raw)
        sets = {}
        for item in sorted(candidates):
            item_id, length, _ = self.items[item]
            wanted = self._shingles(item)
            if length not in sets:
                sets[length] = shingles_of(words, length)
            shared = len(wanted & sets[length])
            if shared * 100 >= len(wanted) * self.threshold:
                yield item_id, shared, len(wanted)

    def _shingles(self, item: int) -> set[tuple[bytes, ...]]:
        if item not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            _, length, raw = self.items[item]
            self.kept[item] = shingles_of(words_of(raw), length)
        return self.kept[item]


def _search(block, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(block.value, threshold)
        for batch in batches:
            numbers = batch.column("doc_id")
            for first, _, data, offsets in byte_slices(batch.column("text")):
                rows = []
                for row, candidates in index.candidates(data, offsets).items():
                    raw = data[offsets[row] : offsets[row + 1]].tobytes()
                    rows += [(numbers[first + row].as_py(), *match) for match in index.matches(raw, candidates)]
                if rows:
                    yield pa.record_batch(
                        [pa.array(v, pa.int64()) for v in zip(*rows)], names=["doc_id", "item_id", "shared", "item_shingles"]
                    )

    return run


def contained_items(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) of all items that a document contains.

    An item is contained if at least threshold / 100 of its distinct five-word shingles
    are in the document; an item of fewer words is one shingle of them all. Items
    without words are in no document, null texts have no words. Of `docs` doc_id and
    text are read, of `items` item_id and text. Rows that repeat or lack a number are
    searched like others and give a row each. Empty tables give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    listed = items.select(F.col("item_id").cast("long"), text_or_empty().alias("text"))
    size = listed.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for k in range(blocks):
        block = spark.sparkContext.broadcast([tuple(row) for row in listed.where(place == k).collect()])
        searched = texts.transform(in_batches).mapInArrow(_search(block, threshold), MATCHES)
        if blocks > 1:
            searched = stage(searched)
            block.destroy()
        found.append(searched)
    return reduce(DataFrame.unionAll, found)


def clean_documents(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` that contain no item, with all their columns; a null doc_id stays."""
    return without_ids(docs, contained_items(docs, items, threshold).select("doc_id"))
