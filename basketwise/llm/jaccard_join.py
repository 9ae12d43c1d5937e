"""Similarity join of documents on five-word shingles by a grouped prefix join.

Two documents link when the Jaccard similarity of their shingle sets reaches the
threshold t. Shingles have one global order, rare ones first. Sets of sizes n and m can
only reach t if they share one of the first n - ceil(t n) + 1 shingles of that order,
their prefixes, and if the smaller size is at least t times the larger.

1. Documents with equal shingle sets are collapsed into one set.
2. Sets with equal prefixes and sizes are collapsed into one group.
3. Groups that share a shingle are candidates if their sizes allow a link and the shingle
   is early enough in both: for two sizes the overlap needed is known, and it is missed
   if none of the first size - overlap + 1 shingles of each is shared.
4. Candidate groups are expanded into their member sets, which are verified exactly.

Only components are asked for, so a set is first compared with one likely partner, the
set that shares most with others (a hub, as the original of many near copies is). After
that, candidates are expanded only across components: a pair within a component cannot
change it. No link between components is lost, and a cluster of
thousands of near copies never becomes all of its pairs.

The order comes from counters that all shingles of all documents are counted in by their
hash, COUNTERS for each document up to 64 MB in all. Shared counters make the order
coarser, never the result different.

No list and no task holds a shingle or a hub whole. Groups of a shingle are sorted by
size in ranges, where a group sees its neighbours; a shingle or hub that many share is
joined by a bounded broadcast; and the sets that are compared with a hub come in blocks,
each with a copy of the hub's set.

Sets have names of 64 bits and a check of another 64. Different sets of one name, if
there are any, are given other names, so equal names mean that all 128 bits agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.components import components
from basketwise.llm.text import byte_slices, in_batches, mix, shingle_sets, text_or_empty, without_ids
from basketwise.operators.skew import join_spread
from basketwise.session import fits_broadcast, release, stage

THRESHOLD = 80
COUNTERS = 16
LEAST_BITS, MOST_BITS = 16, 26
CHUNK_BITS = 16
# Counters stop here; more frequent shingles are ordered by their hash.
MOST_COUNTED = 255
# A likely partner shares one of so many shingles in the prefix; others wait for the search.
LIKELY_SHARE = 50
PLACE_SPAN = 1 << 31
# Bits of the map of wanted documents for each of them, a filter before an exact join.
WANTED = 16
LEAST_WANTED_BITS, MOST_WANTED_BITS = 16, 28
BITMAP_BITS = 32_768
# Sets that are compared with a hub in one piece.
BLOCK = 256
NAME_BITS = 64
CHECK = np.uint64(0x9E3779B97F4A7C15)

PASS_ONE = "doc_id long, n_shingles long, set_id long, set_check long, chunk int, counts binary"


def needed(size, threshold: int):
    """The overlap that a set of this size needs with any set linked to it: ceil(t * size)."""
    return -(-threshold * size // 100)


def set_name(hashes: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """A name of a set and a check of another 64 bits, the same for equal sets."""
    size = np.uint64(len(hashes))
    parts = [np.add.reduce(mix(hashes, 1)) + size, np.add.reduce(mix(hashes ^ CHECK, 0)) + size]
    name, check = (mix(np.array(parts)) >> np.array([64 - bits, 0], np.uint64)).astype(np.int64).tolist()
    return name, check


def set_id(hashes: np.ndarray, renamed: dict, bits: int) -> int:
    name = set_name(hashes, bits)
    return renamed.get(name, name[0])


def _count_pass(bits: int, name_bits: int):
    """Size and name of every document's set; at the end the task's counters in chunks."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("set_id", pa.int64()),
            ("set_check", pa.int64()),
            ("chunk", pa.int32()),
            ("counts", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column("text")):
                sets = shingle_sets(data, offsets)
                places, counts = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                places = places.astype(np.int64)
                counters[places] = np.minimum(counters[places] + counts, MOST_COUNTED)
                names = [set_name(s, name_bits) if len(s) else (None, None) for s in sets]
                columns = [
                    batch.column("doc_id").slice(first, end - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([name for name, _ in names], pa.int64()),
                    pa.array([check for _, check in names], pa.int64()),
                    pa.nulls(len(sets), pa.int32()),
                    pa.nulls(len(sets), pa.binary()),
                ]
                yield pa.record_batch(columns, schema=schema)
        for chunk, part in enumerate(counters.reshape(-1, 1 << CHUNK_BITS)):
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                columns = [*[pa.nulls(1, pa.int64())] * 4, pa.array([chunk], pa.int32()), pa.array([packed], pa.binary())]
                yield pa.record_batch(columns, schema=schema)

    return run


def _add_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the counters of one chunk, cut at MOST_COUNTED."""
    total = np.zeros(1 << CHUNK_BITS, np.uint16)
    for batch in batches:
        for packed in batch.column("counts").to_pylist():
            total = np.minimum(total + np.frombuffer(zlib.decompress(packed), np.uint8), MOST_COUNTED).astype(np.uint16)
    yield pa.record_batch(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "counts"]
    )


def _counters(first: DataFrame, bits: int) -> np.ndarray:
    """The counters of all documents, 2^bits bytes."""
    chunks = first.where("chunk is not null").select("chunk", "counts")
    totals = chunks.groupBy("chunk").applyInArrow(_add_counts, "chunk int, counts binary").collect()
    counters = np.zeros((1 << bits - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8)
    for row in totals:
        counters[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return counters.reshape(-1)


def _new_names(named: DataFrame) -> dict:
    """New names of the sets that share one with another set, by name and check; hardly ever any."""
    clashing = named.groupBy("set_id").agg(F.min("set_check").alias("low"), F.max("set_check").alias("high"))
    clashing = clashing.where("low <> high").select("set_id")
    found = named.join(clashing, "set_id").select("set_id", "set_check").distinct().collect()
    return {(row["set_id"], row["set_check"]): row["set_check"] for row in found}


def _prefix_pass(shared, threshold: int):
    """Per document: its number, and name, size, prefix and name of the prefix of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, renamed, name_bits = shared.value
        shift = np.uint64(64 - (len(counts).bit_length() - 1))
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for first, _, data, offsets in byte_slices(batch.column("text")):
                rows = []
                for number, hashes in zip(numbers[first:], shingle_sets(data, offsets)):
                    if not len(hashes):
                        continue
                    size = len(hashes) - needed(len(hashes), threshold) + 1
                    order = np.lexsort((hashes, counts[hashes >> shift]))[:size]
                    prefix = hashes[order]
                    names = (set_id(hashes, renamed, name_bits), len(hashes), *set_name(np.sort(prefix)))
                    rows.append((number, *names, prefix.astype(np.int64)))
                *longs, prefixes = zip(*rows) if rows else [()] * 6
                columns = [*(pa.array(c, pa.int64()) for c in longs), pa.array(list(prefixes), pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["doc_id", "set_id", "n", "prefix_id", "prefix_check", "prefix"])

    return run


def _with_partner(threshold: int):
    """Of postings sorted by shingle and size those with a neighbour of the same shingle whose size allows a link.

    If neither the next smaller nor the next larger size of a shingle allows one, no
    other does. The first and the last row of a task may have a partner in another task
    and stay.
    """

    def near(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (shingles[1:] == shingles[:-1]) & (sizes[:-1] * 100 >= sizes[1:] * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            links = near(table.column("shingle").to_numpy(), table.column("at").to_numpy() // PLACE_SPAN)
            left = np.concatenate(([before], links))
            keep = left[:-1] | links
            yield table.slice(0, table.num_rows - 1).filter(pa.array(keep))
            held, before = table.slice(table.num_rows - 1), bool(left[-1])
        if held is not None:
            yield held

    return run


def _wanted_pass(shared):
    """The whole sorted sets of the documents whose number is in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, renamed, name_bits = shared.value
        for batch in batches:
            numbers = batch.column("place").to_numpy()
            rows = np.flatnonzero(bits[numbers >> 3] >> (numbers & 7).astype(np.uint8) & 1)
            chosen = batch.take(pa.array(rows))
            for first, end, data, offsets in byte_slices(chosen.column("text")):
                sets = shingle_sets(data, offsets)
                yield pa.record_batch(
                    [
                        chosen.column("doc_id").slice(first, end - first),
                        pa.array([set_id(s, renamed, name_bits) if len(s) else None for s in sets], pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "set_id", "hashes"],
                )

    return run


def _linked(threshold: int):
    """The sets that link with their hub; rows of a hub's block follow each other, the hub's own set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("hub", "member", "set_id"))
            for number, member, name, hashes in zip(*columns, batch.column("hashes")):
                own = np.frombuffer(hashes.as_buffer(), np.uint64)
                if not member:
                    hub = own.copy()
                    continue
                places = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                shared = int((hub[places] == own).sum())
                if shared * 100 >= (len(hub) + len(own) - shared) * threshold:
                    found.append((number, name))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], names=["a", "b"])

    return run


def _sizes_allow(left: str, right: str, threshold: int):
    return F.least(left, right) * 100 >= F.greatest(left, right) * threshold


def _overlap(left: str, right: str, threshold: int):
    """The overlap that two linked sets of these sizes have at least: ceil((n + m) t / (1 + t))."""
    total = (F.col(left) + F.col(right)) * threshold
    return F.floor((total + (99 + threshold)) / (100 + threshold)).cast("long")


def _early(threshold: int):
    """Whether a shingle stands early enough in both sides, of sizes n_a and n_b, to be the first one shared."""
    overlap = _overlap("n_a", "n_b", threshold)
    return (F.col("place_a") <= F.col("n_a") - overlap) & (F.col("place_b") <= F.col("n_b") - overlap)


class _Verifier:
    """Exact similarity of pairs of sets, read from one document of each set."""

    def __init__(self, texts: DataFrame, sets: DataFrame, names: tuple[dict, int], threshold: int):
        self.texts, self.sets, self.names, self.threshold = texts, sets, names, threshold

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold, as stored edges.

        One end of a pair is its hub, the one in more pairs. A hub's partners are cut into
        blocks; the set of a partner is sent to its block once, and the hub's to each block.
        """
        spark = pairs.sparkSession
        ends = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select(F.col("b").alias("set_id")))
        degrees = stage(ends.groupBy("set_id").agg(F.count("*").alias("degree")))
        sided = pairs.select("a", "b")
        for end in ("a", "b"):
            sided = sided.join(degrees.select(F.col("set_id").alias(end), F.col("degree").alias(f"degree_{end}")), end)
        first = F.struct("degree_a", "a") >= F.struct("degree_b", "b")
        sided = sided.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("set_id")
        )
        sided = stage(sided.distinct())
        blocks = stage(sided.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        block = F.pmod(F.xxhash64("set_id"), "blocks").cast("int").alias("block")
        members = join_spread(sided, blocks, ["hub"], "inner").select("hub", block, F.lit(True).alias("member"), "set_id")
        hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        hubs = hubs.select("hub", "block", F.lit(False).alias("member"), F.col("hub").alias("set_id"))
        wanted = stage(members.unionByName(hubs).join(self.sets.select("set_id", "doc_id"), "set_id"))
        count = degrees.count()
        bits = min(max((WANTED * count).bit_length(), LEAST_WANTED_BITS), MOST_WANTED_BITS)
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
        # bitmap_bit_position counts from one number below the bucket's multiple.
        bucket = F.floor(F.col("place") / BITMAP_BITS).cast("int").alias("bucket")
        maps = (
            wanted.select(place.alias("place"))
            .groupBy(bucket)
            .agg(F.bitmap_construct_agg(F.pmod("place", F.lit(BITMAP_BITS))).alias("bits"))
            .collect()
        )
        held = np.zeros((1 << bits) // 8, np.uint8)
        for row in maps:
            start = row["bucket"] * (BITMAP_BITS // 8)
            held[start : start + BITMAP_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
        shared = spark.sparkContext.broadcast((held, *self.names))
        found = self.texts.withColumn("place", place).transform(in_batches).mapInArrow(
            _wanted_pass(shared), "doc_id long, set_id long, hashes binary"
        )
        # A repeated document gives its set again, which changes nothing.
        # A list of checked size is sent to the sets, so that they are shuffled once.
        places = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
        located = found.join(places, ["set_id", "doc_id"]).select("hub", "block", "member", "set_id", "hashes")
        located = located.repartition("hub", "block").sortWithinPartitions("hub", "block", "member")
        edges = stage(located.transform(in_batches).mapInArrow(_linked(self.threshold), "a long, b long"))
        release(degrees, sided, blocks, wanted)
        return edges


def similarity_classes(docs: DataFrame, threshold: int = THRESHOLD, name_bits: int = NAME_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its class under links of similarity >= threshold / 100.

    `docs` has doc_id and text; other columns are not read. A null or empty text has no
    shingles and links with nothing. Equal texts always share a class. Repeated rows
    are reported once each. A row with a null doc_id is reported with its size and a
    null class, unless its set has a numbered document too. component_id is the
    smallest doc_id of the class. An empty table gives an empty result. Shorter names of
    sets, of `name_bits`, cost more and change nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    bits = min(max((COUNTERS * docs.count()).bit_length(), LEAST_BITS), MOST_BITS)
    first = stage(texts.transform(in_batches).mapInArrow(_count_pass(bits, name_bits), PASS_ONE))
    named = first.where("chunk is null").select("doc_id", "n_shingles", "set_id", "set_check")
    renamed = _new_names(named.where("set_id is not null"))
    if renamed:
        rows = [(*name, new) for name, new in renamed.items()]
        new = F.broadcast(spark.createDataFrame(rows, "set_id long, set_check long, new_id long"))
        named = named.join(new, ["set_id", "set_check"], "left").withColumn("set_id", F.coalesce("new_id", "set_id"))
    counters = spark.sparkContext.broadcast((_counters(first, bits), renamed, name_bits))
    sets = stage(
        named.where("set_id is not null and doc_id is not null")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    )
    prefixes = stage(
        texts.where("doc_id is not null")
        .transform(in_batches)
        .mapInArrow(_prefix_pass(counters, threshold), "doc_id long, set_id long, n long, prefix_id long, prefix_check long, prefix array<long>")
    )
    # A group is named by its smallest member.
    group = ["n", "prefix_id", "prefix_check"]
    members = prefixes.groupBy("set_id", *group).agg(F.lit(1).alias("one"))
    names = members.groupBy(*group).agg(F.min("set_id").alias("group_id"))
    members = stage(members.join(names, group).select("set_id", "group_id", "n"))
    # One document has the prefix of its whole group. The others are few unless most
    # documents are copies; prefixes are shuffled only if they are many.
    heads = members.where("set_id = group_id").select("set_id").join(sets.select("set_id", "doc_id"), "set_id")
    others = stage(prefixes.select("doc_id", "set_id").join(heads, ["doc_id", "set_id"], "left_anti").distinct())
    if fits_broadcast(others):
        chosen = prefixes.join(F.broadcast(others), ["doc_id", "set_id"], "left_anti")
    else:
        chosen = prefixes.join(heads, ["doc_id", "set_id"], "left_semi")
    # Size and place in one number, that postings are sorted by.
    placed = (F.col("n") * PLACE_SPAN + F.col("place")).alias("at")
    postings = chosen.select(F.col("set_id").alias("group_id"), "n", F.posexplode("prefix").alias("place", "shingle"))
    postings = postings.select("shingle", placed, "group_id")
    sorted_ = postings.repartitionByRange("shingle", "at", "group_id").sortWithinPartitions("shingle", "at", "group_id")
    size = F.floor(F.col("at") / PLACE_SPAN)
    posted = stage(
        sorted_.mapInArrow(_with_partner(threshold), "shingle long, at long, group_id long").select(
            "shingle", "group_id", size.alias("n"), (F.col("at") - size * PLACE_SPAN).alias("place")
        )
    )
    release(prefixes, others)
    # How many shingles each group shares with others.
    meets = posted.groupBy("group_id").agg(F.count("*").alias("meets"))
    shared = stage(posted.join(meets, "group_id"))
    release(posted)
    verifier = _Verifier(texts, sets, (renamed, name_bits), threshold)

    # One likely partner for each set: the first member of its group, and for that the
    # hub it meets most often.
    inside = members.where("set_id <> group_id").select(F.col("group_id").alias("a"), F.col("set_id").alias("b"))
    hubs = stage(shared.groupBy("shingle").agg(F.max(F.struct("meets", "n", "group_id")).alias("hub")))
    beside = (
        join_spread(shared, hubs, ["shingle"], "inner")
        .select("group_id", "n", F.col("hub.group_id").alias("a"), F.col("hub.n").alias("na"))
        .where((F.col("group_id") != F.col("a")) & _sizes_allow("na", "n", threshold))
        .groupBy("group_id", "n", "a", "na")
        .count()
        .where(F.col("count") * LIKELY_SHARE >= F.greatest("n", "na"))
        .groupBy("group_id", "n")
        .agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        .select("a", F.col("group_id").alias("b"))
    )
    pairs = stage(inside.unionAll(beside))
    likely = verifier.links(pairs)
    release(hubs, pairs)
    known = stage(components(likely))

    def with_class(df: DataFrame, key: str) -> DataFrame:
        found = known.select(F.col("node").alias(key), "component")
        return df.join(found, key, "left").withColumn("class", F.coalesce("component", key)).drop("component")

    # The rest: candidate groups, expanded into members of different classes.
    classed = stage(with_class(members, "set_id"))
    spans = classed.groupBy("group_id", "n").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    spanned = stage(shared.join(spans, ["group_id", "n"]))
    release(shared)
    across = spanned.groupBy("shingle").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"))
    across = stage(across.where("lowest <> highest").select("shingle"))
    mixed = stage(join_spread(spanned, across, ["shingle"], "left_semi").select("shingle", "group_id", "n", "place", "low", "high"))
    release(spanned, across)
    # Groups of one shingle, size and class are one cell, and only cells of different classes meet.
    cell = ["shingle", "n", "low", "high"]
    cells = mixed.groupBy(*cell).agg(F.min("place").alias("place"))
    left, right = (cells.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "low", "high", "place")]) for s in "ab")
    one_class = (F.col("low_a") == F.col("high_a")) & (F.col("low_b") == F.col("high_b")) & (F.col("low_a") == F.col("low_b"))
    ordered = F.struct("n_a", "low_a", "high_a") <= F.struct("n_b", "low_b", "high_b")
    met = left.join(right, "shingle").where(ordered & _sizes_allow("n_a", "n_b", threshold) & _early(threshold) & ~one_class)
    met = met.drop("place_a", "place_b")
    for s in "ab":
        side = mixed.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "low", "high", "place", "group_id")])
        met = met.join(side, ["shingle", f"n_{s}", f"low_{s}", f"high_{s}"])
    group_pairs = (
        met.where((F.col("group_id_a") != F.col("group_id_b")) & _early(threshold))
        .select(F.least("group_id_a", "group_id_b").alias("group_id_a"), F.greatest("group_id_a", "group_id_b").alias("group_id_b"))
        .distinct()
    )
    within = spans.where("low <> high").select(F.col("group_id").alias("group_id_a"), F.col("group_id").alias("group_id_b"))
    ends = [classed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("group_id", "set_id", "class")]) for s in "ab"]
    expanded = (
        group_pairs.unionAll(within)
        .join(ends[0], "group_id_a")
        .join(ends[1], "group_id_b")
        .where("class_a <> class_b and (group_id_a <> group_id_b or set_id_a < set_id_b)")
        .select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b"))
    )
    pairs = stage(expanded)
    release(mixed)
    remaining = verifier.links(pairs)
    classes = components(likely.unionAll(remaining))

    lowest = sets.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "doc_id", F.coalesce("component", "set_id").alias("class")
    )
    lowest = stage(lowest)
    release(pairs, members, classed, known, likely, remaining, sets)
    ids = lowest.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    # A class of very many sets is one row for all of them.
    by_set = stage(join_spread(lowest, ids, ["class"], "inner").select("set_id", "component_id"))
    release(lowest)
    rows = join_spread(named.select("doc_id", "n_shingles", "set_id"), by_set, ["set_id"])
    return rows.select(
        "doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` without near copies: of every class the row of the smallest doc_id stays.

    Rows without shingles all stay, as do rows with a null doc_id. Of rows that repeat
    a doc_id all stay or none. All columns of `docs` are kept.
    """
    classes = similarity_classes(docs, threshold)
    return without_ids(docs, classes.where("component_id < doc_id").select("doc_id"))
