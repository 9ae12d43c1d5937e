"""The trie of conversation prefixes, by the van Emde Boas recursion.

Sequences of turns are cut at half depth. The prefix up to the cut gets a name; the upper
trie is built from the first halves, and a lower forest from the second halves under each
name, both in the same way until single turns are left:

1. Names of blocks of 1, 2, 4, ... turns are made from the names of their halves. Then
   names go down: the first half of a block keeps the name of what comes before it, the
   second half gets the name of that and of the first half. Afterwards every turn knows
   the name of the prefix before it and of the prefix it ends. All blocks of a level are
   named at once. A row holds at most CHUNK turns of a conversation; the chunks of longer
   ones are themselves a sequence, named in the same way.
2. Equal names are one node: its members are counted and the smallest one represents it,
   so (representative, depth) names the node too.
3. Totals go up. At level j, the forests that hang on the nodes at odd multiples of 2^j are
   summed, and each sum is grafted onto the cut node and its ancestors in the upper trie of
   height 2^j. Every pair of node and descendant is met through exactly one cut, and there
   are as many rounds as the depth has binary digits. A node of one conversation is a
   path with one leaf that saves nothing, so only nodes that conversations share take part.

Names have 128 bits. Nothing is grouped whole by conversation or node: turns are numbered by
a sort in ranges, and prefixes that many rows share are joined by a bounded broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketwise.llm.text import mix
from basketwise.session import stage

CHUNK = 512
# Conversations whose numbers are written as one piece of text.
SPAN = 4_096
# A key with more than this share of the rows is joined by broadcast; there are fewer such keys than this.
HOT_SHARE = 1_000
# Conversations of a family share the first turns of the one whose number the family's size divides.
FAMILY, MOST_SHARED = 20, 3
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
BLOCK_TAG, PREFIX_TAG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


# --- turns ------------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, place, name, words) of all turns, places from 0, and (conv, part, n) of their pieces.

    Turns are ordered by turn, null first, then by name. They are sorted in ranges of all
    three, so a conversation may lie in several parts; its place in a part plus the sizes
    of its earlier parts number it. Rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        name.alias("name"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("mark"),
    )
    # The last key divides equal rows.
    keys = ["conv", "turn", "name", "mark"]
    ordered = stage(rows).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = stage(ordered.select("conv", "name", "words", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).alias("part")
    pieces = ordered.groupBy("conv", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stage(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    placed = ordered.withColumn("part", part).join(pieces, ["conv", "part"])
    return placed.select("conv", (F.col("at") - F.col("first") + F.col("before")).alias("place"), "name", "words"), pieces


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, place, name, words, last) of the rebuilt conversations, and (conv, length) of all of them.

    Conversation c starts with the first h turns of conversation c - c % FAMILY, where h
    is the crc32 of its number modulo 4, and goes on with its own after the first h. The
    remainder has the sign of c, as in SQL.
    """
    turns, pieces = numbered_turns(conversations)
    turns = stage(turns)
    sizes = pieces.groupBy("conv").agg(F.sum("n").alias("n"))
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)
    bases = sizes.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = (
        sizes.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), shared.alias("skipped"))
        .join(bases, "base", "left")
        .withColumn("head", F.least("skipped", F.coalesce("base_n", F.lit(0))))
        .withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("skipped"), F.lit(0)))
    )
    plan = stage(plan.select("conv", "base", "skipped", "head", "length"))
    own = turns.join(plan.select("conv", "skipped", "head", "length"), "conv").where("place >= skipped")
    own = own.withColumn("place", F.col("place") - F.col("skipped") + F.col("head"))
    # A family has at most twice FAMILY members, so each of these turns is copied as often at most.
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("place") < MOST_SHARED)).withColumnRenamed("conv", "base")
    heads = heads.join(plan, "base").where("place < head")
    columns = ["conv", "place", "name", "words", (F.col("place") + 1 == F.col("length")).alias("last")]
    return own.select(*columns).unionByName(heads.select(*columns)), plan.select("conv", "length")


# --- names ------------------------------------------------------------------------------


def _named(left: np.ndarray, right: np.ndarray, tag: np.uint64) -> np.ndarray:
    """Names of pairs of names; names are rows of two 64-bit numbers."""
    found = np.empty_like(left)
    for lane in (0, 1):
        value = mix(left[:, lane] + tag, lane)
        for part in (left[:, 1 - lane], right[:, lane], right[:, 1 - lane]):
            value = mix(value * np.uint64(3) + part, lane)
        found[:, lane] = value
    return found


def prefix_names(lengths: np.ndarray, names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each turn of some sequences the name of the prefix before it and of the one it ends.

    `names` holds the turns' names, sequence after sequence, and `starts` the name of what
    comes before each sequence. A sequence fills a block of a power of two above its
    length. Sequences lie in falling order of block size, so blocks of any size are aligned.
    """
    levels = np.ceil(np.log2(lengths + 1)).astype(int)
    order = np.argsort(-levels, kind="stable")
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = np.concatenate(([0], np.cumsum(1 << levels[order])[:-1]))
    before = np.cumsum(lengths) - lengths
    slots = np.arange(len(names)) + np.repeat(offsets - before, lengths)
    top = int(levels.max(initial=0))
    # Places that blocks of at least 2^j fill.
    filled = [int((1 << levels[levels >= j]).sum()) for j in range(top + 2)]
    blocks = [np.zeros((filled[0], 2), np.uint64)]
    blocks[0][slots] = names
    for j in range(top):
        halves = blocks[j][: filled[j + 1] >> j]
        blocks.append(_named(halves[0::2], halves[1::2], BLOCK_TAG))
    prefixes = np.zeros((0, 2), np.uint64)
    for j in range(top, -1, -1):
        wider = np.empty((filled[j] >> j, 2), np.uint64)
        count = 2 * len(prefixes)
        wider[0:count:2] = prefixes
        wider[1:count:2] = _named(prefixes, blocks[j][0:count:2], PREFIX_TAG)
        wider[count:] = starts[order[levels[order] == j]]
        prefixes = wider
    return prefixes[slots], prefixes[slots + 1]


def block_name(names: np.ndarray) -> np.ndarray:
    """The name of a whole sequence of names whose length is a power of two."""
    while len(names) > 1:
        names = _named(names[0::2], names[1::2], BLOCK_TAG)
    return names[0]


def _numbers(column: pa.Array) -> np.ndarray:
    """A column of 16-byte values as rows of two 64-bit numbers."""
    if not len(column):
        return np.zeros((0, 2), np.uint64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u8").reshape(-1, 2)


def _bytes(numbers: np.ndarray) -> pa.Array:
    offsets = np.arange(0, 16 * len(numbers) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(numbers.tobytes())])


def _name_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = batch.column("turns")
        lengths = np.diff(turns.offsets.to_numpy()).astype(np.int64)
        flat = turns.flatten()
        place, words, last = (flat.field(flat.type.get_field_index(c)) for c in ("place", "words", "last"))
        name = flat.field(flat.type.get_field_index("name"))
        before, after = prefix_names(lengths, _numbers(name), _numbers(batch.column("start")))
        # The end of a whole chunk has the name the sequence of chunks gives it.
        ends, after = batch.column("finish"), after.copy()
        given = np.flatnonzero(ends.is_valid().to_numpy(zero_copy_only=False))
        after[np.cumsum(lengths)[given] - 1] = _numbers(ends.take(pa.array(given)))
        conv = pa.array(np.repeat(batch.column("conv").to_numpy(), lengths))
        yield pa.record_batch(
            [conv, place, words, last, _bytes(before), _bytes(after)],
            names=["conv", "place", "words", "last", "parent", "name"],
        )


def _name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = batch.column("turns")
        ends = np.cumsum(np.diff(turns.offsets.to_numpy()))
        flat = turns.flatten()
        names = _numbers(flat.field(flat.type.get_field_index("name")))
        whole = np.flatnonzero(batch.column("whole").to_numpy(zero_copy_only=False))
        size = int(batch.column("size")[0].as_py())
        # A chunk cut short ends its conversation: its own name is not asked for.
        found = np.zeros((batch.num_rows, 2), np.uint64)
        for row in whole:
            found[row] = block_name(names[ends[row] - size : ends[row]])
        yield pa.record_batch([batch.column("conv"), batch.column("chunk"), _bytes(found)], names=["conv", "place", "name"])


def with_prefix_names(turns: DataFrame, longest: int, chunk: int = CHUNK) -> DataFrame:
    """(conv, place, words, last, parent, name): `turns` with the names of the prefixes before and after each.

    `longest` is the largest number of turns; `chunk`, a power of two, those of a row.
    """
    entry = F.struct("place", "name", "words", "last")
    grouped = turns.groupBy("conv", F.floor(F.col("place") / chunk).alias("chunk")).agg(
        F.sort_array(F.collect_list(entry)).alias("turns")
    )
    if longest <= chunk:
        grouped = grouped.withColumns({"start": F.lit(ROOT), "finish": F.lit(None).cast("binary")})
    else:
        grouped = stage(grouped.withColumn("whole", F.size("turns") == chunk).withColumn("size", F.lit(chunk)))
        blocks = grouped.mapInArrow(_name_blocks, "conv long, place long, name binary")
        blocks = blocks.withColumns({"words": F.lit(0).cast("long"), "last": F.lit(False)})
        above = with_prefix_names(blocks, -(-longest // chunk), chunk)
        names = above.select("conv", F.col("place").alias("chunk"), F.col("parent").alias("start"), F.col("name").alias("end"))
        grouped = grouped.join(names, ["conv", "chunk"]).withColumn("finish", F.when(F.col("whole"), F.col("end")))
    return grouped.select("conv", "turns", "start", "finish").mapInArrow(
        _name_chunks, "conv long, place long, words long, last boolean, parent binary, name binary"
    )


# --- nodes ------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each name's pieces of text joined by commas; pieces of a name follow each other."""
    name, digest = None, None
    for batch in batches:
        names, found = [], []
        for key, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist()):
            if key == name:
                digest.update(b",")
            else:
                if digest:
                    names.append(name)
                    found.append(digest.hexdigest())
                name, digest = key, hashlib.sha256()
            digest.update(piece.encode())
        yield pa.record_batch([pa.array(names, pa.binary()), pa.array(found, pa.string())], names=["name", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the conversations (name, conv) that end at each node.

    Numbers become text in pieces of bounded size; one task reads the pieces of a node in
    order, as the digest demands, and holds one batch of them.
    """
    numbers = F.sort_array(F.collect_list("conv"))
    pieces = ends.groupBy("name", F.floor(F.col("conv") / SPAN).alias("span")).agg(
        F.array_join(F.transform(numbers, lambda c: c.cast("string")), ",").alias("piece")
    )
    ordered = pieces.repartition("name").sortWithinPartitions("name", "span")
    return ordered.select("name", "piece").mapInArrow(_digests, "name binary, ends_sha256 string")


def _with_rep(rows: DataFrame, key: str, nodes: DataFrame, column: str) -> DataFrame:
    """`rows` with the representative of the node that `key` names, null if `nodes` (name, rep) lacks it.

    Names of more than 1 / HOT_SHARE of the rows, fewer than HOT_SHARE of them, are sent to
    the rows, so that the rows of none of them meet in one task.
    """
    total = rows.count()
    hot = rows.groupBy(key).count().where(F.col("count") * HOT_SHARE > total).select(F.col(key).alias("name"))
    hot = hot.join(nodes, "name").select(F.col("name").alias(key), F.col("rep").alias(column))
    marked = rows.join(F.broadcast(stage(hot)), key, "left")
    known = nodes.select(F.col("name").alias(key), F.col("rep").alias(column))
    rest = marked.where(F.col(column).isNull()).drop(column).join(known, key, "left")
    return marked.where(F.col(column).isNotNull()).unionByName(rest)


def _grafted(shared: DataFrame, paths: DataFrame) -> DataFrame:
    """(rep, depth, leaves, saved): sums of the own values over the subtrees of the shared nodes.

    `shared` has rep, depth, parent_rep and own leaves and saved; `paths` (conv, depth, rep)
    the nodes on the way to every node whose representative is conv.
    """
    totals = stage(shared.select("rep", "depth", "parent_rep", "leaves", "saved"))
    deepest = totals.agg(F.max("depth")).first()[0] or 0
    for level in range((deepest - 1).bit_length() if deepest else 0):
        half = 1 << level
        roots = totals.where((F.col("depth") - 1).bitwiseAND(2 * half - 1) == half)
        forests = roots.groupBy(F.col("parent_rep").alias("conv"), (F.col("depth") - 1).alias("cut")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        cut = (F.ceil(F.col("depth") / half) * half).alias("cut")
        upper = paths.select("conv", "depth", "rep", cut).where(F.col("cut").bitwiseAND(2 * half - 1) == half)
        added = upper.join(forests, ["conv", "cut"]).select(
            "rep", "depth", F.lit(None).cast("long").alias("parent_rep"), "leaves", "saved"
        )
        totals = stage(
            totals.unionByName(added)
            .groupBy("rep", "depth")
            .agg(F.max("parent_rep").alias("parent_rep"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        )
    return totals.drop("parent_rep")


def trie(turns: DataFrame, lengths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of some sequences, the root included.

    `turns` has conv, place (from 0), name (16 bytes), words and last (whether it is the
    sequence's last turn), `lengths` the length of every conv, 0 too. Without sequences
    there are no nodes.
    """
    spark = turns.sparkSession
    lengths = stage(lengths)
    whole = lengths.agg(F.count("*").alias("n"), F.min("conv").alias("rep"), F.max("length").alias("longest")).first()
    if not whole["n"]:
        return spark.createDataFrame([], NODE)
    named = with_prefix_names(turns, whole["longest"], chunk)
    named = stage(named.select("conv", (F.col("place") + 1).alias("depth"), "words", "last", "parent", "name"))
    ends = named.where("last").select("name", "conv").unionByName(
        lengths.where("length = 0").select(F.lit(ROOT).alias("name"), "conv")
    )
    nodes = stage(
        named.groupBy("depth", "name").agg(
            F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.max("words").alias("words")
        )
    )
    children = nodes.groupBy(F.col("parent").alias("name")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")
    )
    nodes = stage(
        nodes.join(children, "name", "left")
        .join(_end_digests(ends), "name", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "single")})
    )
    root = spark.createDataFrame([(ROOT, whole["rep"])], "name binary, rep long")
    several = stage(nodes.where("n_convs > 1").select("name", "rep").unionByName(root))
    # A node whose parent is no shared one has its parent's representative.
    nodes = stage(_with_rep(nodes, "parent", several, "parent_rep").withColumn("parent_rep", F.coalesce("parent_rep", "rep")))
    shared = nodes.where("n_convs > 1").withColumns(
        {
            "leaves": F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("single")).cast("long"),
            "saved": (F.col("n_convs") - 1) * F.col("words"),
        }
    )
    shared = stage(shared.select("rep", "depth", "parent_rep", "leaves", "saved"))
    ways = shared.groupBy(F.col("rep").alias("conv")).agg(F.max("depth").alias("deepest"))
    paths = stage(named.select("conv", "depth", "name").join(ways, "conv").where("depth <= deepest").drop("deepest"))
    totals = _grafted(shared, stage(_with_rep(paths, "name", several, "rep").select("conv", "depth", "rep")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(totals, ["rep", "depth"], "left").select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.col("parent_rep").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    found = stage(found)
    below = found.where("depth = 1").agg(
        F.count("*").alias("n_children"),
        F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    )
    at_root = _end_digests(ends.where(F.col("name") == F.lit(ROOT))).agg(F.max("ends_sha256").alias("digest"))
    top = below.withColumn("digest", at_root.scalar()).select(
        F.lit(whole["rep"]).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(whole["n"]).cast("long").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("digest", nothing).alias("ends_sha256"),
    )
    return found.unionByName(top)


def conversation_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The prefix trie of all rebuilt conversations; see `rebuilt_turns` and `trie`.

    `conversations` has conv_id, turn, role and text; other columns are not read. Null roles
    and texts are empty, null turns come first, rows of one turn number are ordered by
    the SHA-256 of role and text, and repeated rows are turns of their own. Rows without
    conv_id are left out. An empty table gives no nodes.
    """
    return trie(*rebuilt_turns(conversations), chunk)
