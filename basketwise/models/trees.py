"""Boosted trees and forests grown from counts of binned rows.

The rows are binned once and stored in blocks, a byte for each feature. A pass over the
blocks counts rows and sums targets by node, feature and bin; the driver gets these sums,
of a bounded number of nodes at a time, and picks the splits. Splits, stops and leaf values
are those of Spark's tree ensembles; cuts come from all rows instead of a sample. Nodes of a
forest that hold few enough rows are finished where their rows are dealt to. A tree is a few
flat arrays. The trees of a large forest are stored and never all at one place.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketwise.session import release, stage

# Bins of a feature at most.
BINS = 32
# Values of a feature that a block's rows are summed up by when its cuts are sought.
SKETCH_VALUES = 4_096
# Rows of a block.
BLOCK_ROWS = 16_384
# Rows that one task grows a tree or a part of one from, at most.
TASK_ROWS = 400_000
# Rows that one task of a pass of boosting reads, about; it holds a block of them.
PASS_ROWS = 2_000_000
# Cells of one pass over the rows, at most, if it is for several nodes.
PASS_CELLS = 1 << 17
# Rows that are counted row by row, at most; beyond, column by column.
FEW_ROWS = 1_024
# Values that are sorted at once for the cuts.
ENTRIES = 1 << 22
# Nodes of a tree that is followed by whole columns, at most.
SMALL_TREE = 63
# Trees between two stored copies of the boosted scores, and trees of a forest that are finished in one job.
COPY_TREES, WAVE_TREES = 20, 20
# Nodes of an ensemble that the driver holds, at most; the trees of a larger forest are a stored frame.
HELD_NODES = 1 << 19
# Nodes and rows that one task scores with stored trees, about.
PART_NODES, CHUNK_ROWS = 1 << 20, 1 << 18
# Parts that the sums of a pass are cut into to be added up.
PIECES = 16
# A gain of a smaller part of what it is a difference of is rounding.
ROUNDING = 1e-12

BLOCK = "block long, rows int, bins binary, codes binary, label binary, score binary"
VALUES = "values array<double>, codes array<int>, label double"


@dataclass(frozen=True)
class Layout:
    """Cuts of the numbers, and how many values each coded column has."""

    cuts: list[np.ndarray]
    values: list[int] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return max([len(c) + 1 for c in self.cuts], default=1)

    @property
    def dense(self) -> int:
        return len(self.cuts) * self.bins

    @property
    def cells(self) -> int:
        return self.dense + sum(self.values)

    @property
    def features(self) -> int:
        return len(self.cuts) + sum(self.values)

    def binned(self, values: np.ndarray) -> np.ndarray:
        found = [np.searchsorted(cut, values[:, i], "left") for i, cut in enumerate(self.cuts)]
        return np.stack(found, 1).astype(np.uint8) if found else np.zeros((len(values), 0), np.uint8)

    def feature_of(self, cell: int) -> int:
        return cell // self.bins if cell < self.dense else len(self.cuts) + cell - self.dense

    def split_of(self, cell: int) -> tuple[int, int]:
        """Column and cut: the last bin on the left of a number, or the value on the right of a coded column."""
        if cell < self.dense:
            return cell // self.bins, cell % self.bins
        ends = np.cumsum(self.values)
        column = int(np.searchsorted(ends, cell - self.dense, "right"))
        return len(self.cuts) + column, int(cell - self.dense - (ends[column] - self.values[column]))

    def right(self, rows: np.ndarray, column: int, cut: int) -> np.ndarray:
        return rows[:, column] > cut if column < len(self.cuts) else rows[:, column] == cut


@dataclass
class Trees:
    """Nodes in flat arrays: column, cut, left child (the right one follows; a leaf is its own child) and mean target."""

    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int

    def leaves(self, layout: Layout, rows: np.ndarray) -> np.ndarray:
        if len(self.child) <= SMALL_TREE:
            return np.broadcast_to(self._below(layout, rows, 0), len(rows))
        node = np.zeros(len(rows), np.int64)
        place = np.arange(len(rows))
        for _ in range(self.depth):
            column, cut = self.column[node], self.cut[node]
            found = rows[place, column]
            right = found > cut
            if layout.values:
                right = np.where(column < len(layout.cuts), right, found == cut)
            node = self.child[node] + (right & (self.child[node] != node))
        return node

    def _below(self, layout: Layout, rows: np.ndarray, node: int) -> np.ndarray:
        """The leaves if every row were at this node: a comparison of whole columns for each split."""
        left = int(self.child[node])
        if left == node:
            return np.int32(node)
        right = layout.right(rows, int(self.column[node]), int(self.cut[node]))
        return np.where(right, self._below(layout, rows, left + 1), self._below(layout, rows, left))

    def predicted(self, layout: Layout, rows: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(layout, rows)]


class Growing:
    """The nodes of one tree while it grows, and what each feature gained."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.nodes: list[list] = [[0, 0, 0, 0.0]]
        self.gains = np.zeros(layout.features)

    def split(self, node: int, found: Split) -> tuple[int, int]:
        left = len(self.nodes)
        self.nodes[node][:3] = [*self.layout.split_of(found.cell), left]
        self.nodes += [[0, 0, left, found.means[0]], [0, 0, left + 1, found.means[1]]]
        self.gains[self.layout.feature_of(found.cell)] += found.gain
        return left, left + 1

    def tree(self, depth: int) -> Trees:
        column, cut, child, value = zip(*self.nodes)
        return Trees(np.array(column, np.int32), np.array(cut, np.int32), np.array(child, np.int32), np.array(value, float), depth)


@dataclass(frozen=True)
class Split:
    """The best split of a node: its cell, gain times rows, and rows and mean target of both sides."""

    cell: int
    gain: float
    rows: tuple[float, float]
    means: tuple[float, float]


def cells(
    layout: Layout, rows: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, place: np.ndarray | None = None, nodes: int = 1, paired: bool = False
) -> np.ndarray:
    """Rows and summed targets by node and cell: an array (2, nodes, cells).

    With `paired`, numbers are counted two columns at a time, in cells of both, which takes
    less than half as long; sums then differ in their last bits.
    """
    dense, width, size = len(layout.cuts), rows.shape[1], nodes * layout.cells
    starts = np.concatenate([np.arange(dense) * layout.bins, layout.dense + np.cumsum([0, *layout.values])[:-1]]).astype(np.int64)
    ends = np.array([layout.bins] * dense + list(layout.values))
    found = np.zeros((2, size))
    if len(rows) <= FEW_ROWS:
        keys = rows + starts
        if place is not None:
            keys += place[:, None] * layout.cells
        known = rows < ends
        times = None if weight is None else np.repeat(weight, width).reshape(keys.shape)[known]
        sums = np.repeat(target if weight is None else target * weight, width).reshape(keys.shape)[known]
        found[0] = np.bincount(keys[known], times, size)
        found[1] = np.bincount(keys[known], sums, size)
        return found.reshape(2, nodes, -1)
    found = found.reshape(2, nodes, -1)
    summed = target if weight is None else target * weight
    keys, shifts = np.empty(len(rows), np.int64), {}
    bins, first = layout.bins, 0
    if paired and dense > 1:
        first = dense - dense % 2
        shift = None if place is None else place * (bins * bins)
        for i in range(0, first, 2):
            np.multiply(rows[:, i], bins, out=keys, dtype=np.int64)
            keys += rows[:, i + 1]
            if shift is not None:
                keys += shift
            for k, weights in enumerate((weight, summed)):
                both = np.bincount(keys, weights, nodes * bins * bins).reshape(nodes, bins, bins)
                found[k, :, starts[i] : starts[i] + bins] = both.sum(2)
                found[k, :, starts[i + 1] : starts[i + 1] + bins] = both.sum(1)
    for i, (start, end) in list(enumerate(zip(starts, ends)))[first:]:
        # One bin more for values that are not known.
        bins = end if i < dense else end + 1
        if place is None:
            keys[:] = rows[:, i]
        else:
            if bins not in shifts:
                shifts = {bins: place * bins}
            np.add(shifts[bins], rows[:, i], out=keys)
        for k, weights in enumerate((weight, summed)):
            found[k, :, start : start + end] = np.bincount(keys, weights, nodes * bins).reshape(nodes, bins)[:, :end]
    return found


def best_splits(layout: Layout, sums: np.ndarray, totals: np.ndarray, least: float, paired: bool = False) -> list[Split | None]:
    """The best split of every node; of equal ones that of the first feature and cut.

    `sums` comes from `cells`, `totals` holds rows and summed targets of each node. Sums of
    columns counted in pairs are equal but for rounding.
    """
    nodes = sums.shape[1]
    dense = sums[:, :, : layout.dense].reshape(2, nodes, len(layout.cuts), layout.bins)
    left = np.cumsum(dense, 3).reshape(2, nodes, -1)
    if layout.values:
        left = np.concatenate([left, totals[:, :, None] - sums[:, :, layout.dense :]], 2)
    right = totals[:, :, None] - left
    able = (left[0] >= max(least, 1)) & (right[0] >= max(least, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = left[1] ** 2 / left[0] + right[1] ** 2 / right[0]
        gain = np.where(able, apart - (totals[1] ** 2 / totals[0])[:, None], -np.inf)
    found: list[Split | None] = []
    best = gain.argmax(1) if layout.cells else np.zeros(0, int)
    if paired and len(best):
        top = np.take_along_axis(gain, best[:, None], 1) - ROUNDING * np.abs(np.take_along_axis(np.where(able, apart, 0), best[:, None], 1))
        best = (gain >= top).argmax(1)
    for k, cell in enumerate(best):
        if not gain[k, cell] > ROUNDING * apart[k, cell]:
            found.append(None)
            continue
        sides = [(side[0, k, cell], side[1, k, cell]) for side in (left, right)]
        found.append(Split(int(cell), float(gain[k, cell]), tuple(float(n) for n, _ in sides), tuple(float(s / n) for n, s in sides)))
    return found or [None] * nodes


# Sums of some nodes of a growing tree.
Count = Callable[[Trees, np.ndarray], tuple[np.ndarray, np.ndarray]]


def grow(layout: Layout, depth: int, least: float, count: Count, paired: bool = False) -> tuple[Trees, np.ndarray]:
    """A tree, level by level, and the features' gains; `count` gives sums and totals of the given nodes."""
    growing, open_nodes = Growing(layout), [0]
    for level in range(depth):
        sums, totals = count(growing.tree(level), np.array(open_nodes))
        if not level:
            growing.nodes[0][3] = float(totals[1, 0] / totals[0, 0])
        splits = best_splits(layout, sums, totals, least, paired)
        open_nodes = [child for node, split in zip(open_nodes, splits) if split for child in growing.split(node, split)]
        if not open_nodes:
            break
    return growing.tree(depth), growing.gains


def grow_whole(layout: Layout, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: float) -> tuple[Trees, np.ndarray]:
    """A tree from rows at hand, one node after the other."""
    growing = Growing(layout)
    growing.nodes[0][3] = float(np.average(target, weights=weight))
    todo = [(0, rows, target, weight, 0)]
    while todo:
        node, rows, target, weight, level = todo.pop()
        if level >= depth or weight.sum() < 2 * max(least, 1):
            continue
        sums = cells(layout, rows, target, weight)
        totals = np.array([[weight.sum()], [(weight * target).sum()]])
        split = best_splits(layout, sums, totals, least)[0]
        if split is None:
            continue
        left, right = growing.split(node, split)
        side = layout.right(rows, *layout.split_of(split.cell))
        for child, mine in ((right, side), (left, ~side)):
            todo.append((child, rows[mine], target[mine], weight[mine], level + 1))
    return growing.tree(depth), growing.gains


# --- blocks --------------------------------------------------------------------------


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("values")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("codes")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0), np.int32)


def _summed_up(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most about `most` of sorted distinct values, evenly many rows apart, and the rows up to each."""
    if len(values) <= most:
        return values, counts
    ends = np.cumsum(counts)
    kept = np.unique(np.searchsorted(ends, np.linspace(0, ends[-1], most + 1)[1:], "left"))
    return values[kept], np.diff(ends[kept], prepend=0)


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted lists, one after the other, and their counts added up."""
    # This kind of sorting only merges what is in order.
    order = np.argsort(values, kind="stable")
    values, counts = values[order], np.asarray(counts, float)[order]
    if not len(values):
        return values, counts
    later, before = values[1:], values[:-1]
    first = np.flatnonzero(np.concatenate([[True], (later != before) & ~(np.isnan(later) & np.isnan(before))]))
    return values[first], np.add.reduceat(counts, first)


def cuts_of(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between sorted distinct values that part the rows about evenly, by the rule of Spark's trees."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles
    stride, found = counts.sum() / bins, []
    target, ends = stride, np.cumsum(counts)
    for before, now, middle in zip(ends[:-1], ends[1:], middles):
        if abs(before - target) < abs(now - target):
            found.append(middle)
            target += stride
    return np.array(found)


def find_cuts(frame: DataFrame, width: int) -> list[np.ndarray]:
    """The cuts of all numbers, from all rows; beyond `SKETCH_VALUES` values a task sums its rows up by as many of them."""

    def seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0))] * width
        waiting: list[np.ndarray] = []

        def take() -> None:
            for i in range(width if waiting else 0):
                values, counts = np.unique(np.concatenate([part[:, i] for part in waiting]), return_counts=True)
                values, counts = _merged(np.concatenate([held[i][0], values]), np.concatenate([held[i][1], counts]))
                # Far finer than a task's result.
                held[i] = _summed_up(values, counts, 16 * SKETCH_VALUES)
            waiting.clear()

        for batch in batches:
            if len(batch):
                waiting.append(_numbers(batch))
            if sum(part.size for part in waiting) >= ENTRIES:
                take()
        take()
        for i, (values, counts) in enumerate(held):
            values, counts = _summed_up(values, counts, SKETCH_VALUES)
            yield pa.record_batch([pa.array([i]), pa.array([values]), pa.array([counts.astype(float)])], names=["feature", "found", "counts"])

    def cut(table: pa.Table) -> pa.Table:
        values, counts = (np.concatenate([np.asarray(x) for x in table.column(c).to_pylist()]) for c in ("found", "counts"))
        cuts = cuts_of(*_merged(values, counts)) if len(values) else np.zeros(0)
        return pa.table({"feature": table.column("feature")[:1], "cuts": [cuts]})

    sketches = frame.mapInArrow(seen, "feature long, found array<double>, counts array<double>")
    rows = sketches.groupBy("feature").applyInArrow(cut, "feature long, cuts array<double>").collect()
    return [np.array(row["cuts"], float) for row in sorted(rows, key=lambda row: row["feature"])]


def store_blocks(frame: DataFrame, layout: Layout) -> DataFrame:
    """The rows of a frame (VALUES), binned, in stored blocks with a score of 0."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block(parts: list[tuple]) -> pa.RecordBatch:
            bins, codes, label = (np.concatenate(part) for part in zip(*parts))
            columns = [[number], [len(bins)], [bins.T.tobytes()], [codes.astype(np.int32).tobytes()], [label.tobytes()], [bytes(8 * len(bins))]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, BLOCK_TYPES)], names=BLOCK_NAMES)

        for batch in batches:
            if not len(batch):
                continue
            values = _numbers(batch)
            held.append((layout.binned(values), _codes(batch), batch.column("label").to_numpy(zero_copy_only=False)))
            if sum(len(part[0]) for part in held) >= BLOCK_ROWS:
                yield block(held)
                number, held = number + 1, []
        if held:
            yield block(held)

    return stage(frame.mapInArrow(pack, BLOCK))


BLOCK_NAMES = [part.split()[0] for part in BLOCK.split(", ")]
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


@dataclass
class Block:
    """Binned rows with their label and score."""

    number: int
    rows: np.ndarray
    label: np.ndarray
    score: np.ndarray


def _block(layout: Layout, number: int, size: int, *parts) -> Block:
    bins, codes, label, score = (np.frombuffer(part, t) for part, t in zip(parts, (np.uint8, np.int32, float, float)))
    # Column by column, as they are counted.
    rows = bins.reshape(-1, size).T if len(bins) else np.zeros((size, 0), np.uint8)
    if layout.values:
        rows = np.concatenate([rows.T.astype(np.int32), codes.reshape(size, -1).T]).T
    return Block(number, rows, label, score)


def _blocks(layout: Layout, batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        columns = [batch.column(c) for c in BLOCK_NAMES]
        for k in range(len(batch)):
            yield _block(layout, columns[0][k].as_py(), columns[1][k].as_py(), *[column[k].as_buffer() for column in columns[2:]])


def _collected(frame: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], object]) -> list:
    """What `make` returns for each partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([pickle.dumps(make(batches))], pa.binary())], names=["found"])

    return [pickle.loads(row["found"]) for row in frame.mapInArrow(run, "found binary").collect()]


def _summed(frame: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of what `make` returns for each partition, added up piece by piece before the driver gets it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, values in enumerate(np.array_split(make(batches), PIECES)):
            columns = [pa.array([piece], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([values.tobytes()], pa.binary())]
            yield pa.record_batch(columns, names=["piece", "part", "sums"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = None, None
        for batch in batches:
            for k in range(len(batch)):
                own, values = batch.column("piece")[k].as_py(), np.frombuffer(batch.column("sums")[k].as_buffer())
                if held is not None and own != piece:
                    yield pa.record_batch([pa.array([piece], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["piece", "sums"])
                held = held + values if own == piece else values
                piece = own
        if held is not None:
            yield pa.record_batch([pa.array([piece], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["piece", "sums"])

    # In the order of the partitions, so that equal blocks give equal sums.
    parts = frame.mapInArrow(run, "piece int, part int, sums binary").repartition(PIECES, "piece").sortWithinPartitions("piece", "part")
    found = sorted(parts.mapInArrow(add, "piece int, sums binary").collect(), key=lambda row: row["piece"])
    return np.concatenate([np.frombuffer(row["sums"]) for row in found])


# --- boosting ------------------------------------------------------------------------

# The target of the next tree, by label and score so far.
TARGETS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "squared": lambda label, score: 2.0 * (label - score),
    # Labels are -1 and 1.
    "logistic": lambda label, score: 4.0 * label / (1.0 + np.exp(np.minimum(2.0 * label * score, 700.0))),
}


@dataclass
class Ensemble:
    """Fitted trees with their weights, and the features' importances.

    The trees of a forest of more than `HELD_NODES` nodes are the rows of a frame (STORED),
    `nodes` in all; the lists are empty then.
    """

    layout: Layout
    trees: list[Trees]
    weights: list[float]
    importances: np.ndarray
    stored: DataFrame | None = None
    nodes: int = 0

    def total(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros(len(rows))
        for tree, weight in zip(self.trees, self.weights):
            found += weight * tree.predicted(self.layout, rows)
        return found


def _shares(gains: np.ndarray) -> np.ndarray:
    return gains / gains.sum() if gains.sum() > 0 else gains


def boost(blocks: DataFrame, layout: Layout, loss: str, trees: int, rate: float, depth: int, least: int, task_rows: int = TASK_ROWS) -> Ensemble:
    """Boosted trees. The first is fitted to the labels and counts in full, later ones to the loss's target at `rate`.

    The blocks are kept in memory, or on the executors' disks, with the scores of the trees so
    far. Up to `task_rows` rows are one task's work, which spares a job for each level.
    """
    weights = [1.0] + [rate] * (trees - 1)
    size = blocks.agg(F.sum("rows")).first()[0] or 0
    if not size:
        raise ValueError("no rows to fit trees on")
    if size <= task_rows:
        found = _collected(blocks.coalesce(1), lambda batches: _boosted(list(_blocks(layout, batches)), layout, loss, weights, depth, least))
        grown = found[0]
    else:
        grown = _boosted_on_spark(blocks, size, layout, loss, weights, depth, least)
    return Ensemble(layout, [tree for tree, _ in grown], weights, _shares(sum(gains for _, gains in grown)))


def _target(block: Block, loss: str, m: int) -> np.ndarray:
    return TARGETS[loss](block.label, block.score) if m else block.label


def _node_sums(layout: Layout, blocks: Iterable[tuple], tree: Trees, nodes: np.ndarray, paired: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums by cell and totals of some nodes over (rows, target, weight)."""
    sums, totals = np.zeros((2, len(nodes), layout.cells)), np.zeros((2, len(nodes)))
    places = np.full(len(tree.column), -1)
    places[nodes] = np.arange(len(nodes))
    for rows, target, weight in blocks:
        place = places[tree.leaves(layout, rows)]
        inside = place >= 0
        known = np.count_nonzero(inside)
        if 2 * known < len(rows):
            rows, target, place = rows[inside], target[inside], place[inside]
            weight = None if weight is None else weight[inside]
        elif known < len(rows):
            # Few other rows are counted at one more node, which is cheaper than to copy the rest.
            place[~inside] = len(nodes)
        counted = len(nodes) + (2 * known >= len(rows) > known)
        sums += cells(layout, rows, target, weight, place, counted, paired)[:, : len(nodes)]
        totals[0] += np.bincount(place, weight, counted)[: len(nodes)]
        totals[1] += np.bincount(place, target if weight is None else target * weight, counted)[: len(nodes)]
    return sums, totals


def _boosted(blocks: list[Block], layout: Layout, loss: str, weights: list[float], depth: int, least: int) -> list:
    """Boosted trees of the blocks of one task."""
    blocks = sorted(blocks, key=lambda block: block.number)
    rows, label, score = (np.concatenate([getattr(b, name) for b in blocks]) for name in ("rows", "label", "score"))
    grown = []
    for m, weight in enumerate(weights):
        target = _target(Block(0, rows, label, score), loss, m)
        tree, gains = grow(layout, depth, least, lambda tree, nodes: _node_sums(layout, [(rows, target, None)], tree, nodes))
        score = score + weight * tree.predicted(layout, rows)
        grown.append((tree, gains))
    return grown


def _boosted_on_spark(blocks: DataFrame, size: int, layout: Layout, loss: str, weights: list[float], depth: int, least: int) -> list:
    """Boosted trees from passes over all blocks, one for each level."""
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-size // PASS_ROWS))
    state, before, copy, grown = _kept(blocks, layout, tasks), None, None, []
    for m, weight in enumerate(weights):
        grown.append(grow(layout, depth, least, _counted_on_spark(state, layout, loss, m), True))
        # The first pass over the new scores has kept them.
        if before is not None:
            before.unpersist()
        if m + 1 < len(weights):
            before, state = state, _with_scores(state, layout, grown[m][0], weight)
        if m + 1 < len(weights) and (m + 1) % COPY_TREES == 0:
            # A lost block is then made again from a copy of few trees ago.
            later = _stored(blocks, state, layout)
            before.unpersist()
            state.unpersist()
            if copy is not None:
                release(copy)
            before, state, copy = None, _kept(later, layout, tasks), later
    state.unpersist()
    if copy is not None:
        release(copy)
    return grown


def _kept(blocks: DataFrame, layout: Layout, tasks: int) -> RDD:
    """The blocks, dealt out evenly to tasks and kept by the executors."""
    dealt = blocks.select(*BLOCK_NAMES).repartitionByRange(tasks, "block")
    return dealt.rdd.map(lambda row: _block(layout, *row)).persist(StorageLevel.MEMORY_AND_DISK)


def _counted_on_spark(state: RDD, layout: Layout, loss: str, m: int) -> Count:
    def count(tree: Trees, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def make(blocks: Iterable[Block]) -> Iterator[tuple]:
            yield _node_sums(layout, ((b.rows, _target(b, loss, m), None) for b in blocks), tree, nodes, True)

        found = state.mapPartitions(make).collect()
        return sum(sums for sums, _ in found), sum(totals for _, totals in found)

    return count


def _with_scores(state: RDD, layout: Layout, tree: Trees, weight: float) -> RDD:
    def add(block: Block) -> Block:
        return Block(block.number, block.rows, block.label, block.score + weight * tree.predicted(layout, block.rows))

    return state.map(add).persist(StorageLevel.MEMORY_AND_DISK)


def _stored(blocks: DataFrame, state: RDD, layout: Layout) -> DataFrame:
    """The blocks with their scores so far, stored as the executors keep them."""
    dense = len(layout.cuts)

    def as_row(block: Block) -> tuple:
        bins = block.rows[:, :dense].astype(np.uint8).T.tobytes()
        codes = np.ascontiguousarray(block.rows[:, dense:], np.int32).tobytes()
        return block.number, len(block.rows), *(bytearray(part) for part in (bins, codes, block.label.tobytes(), block.score.tobytes()))

    return stage(blocks.sparkSession.createDataFrame(state.map(as_row), BLOCK))


# --- forests -------------------------------------------------------------------------


def _times(block: Block, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree, with replacement."""
    return np.random.default_rng([seed, tree, block.number]).poisson(1.0, len(block.rows)).astype(float)


def forest(blocks: DataFrame, layout: Layout, trees: int, depth: int, least: int, seed: int, task_rows: int = TASK_ROWS) -> Ensemble:
    """Trees of rows drawn with replacement, each with the same weight.

    Nodes of more than `task_rows` rows are split by passes over all rows. The rows of
    the others are dealt to tasks, some trees at a time, and each is finished by one task.
    """
    size = blocks.agg(F.sum("rows")).first()[0] or 0
    if not size:
        raise ValueError("no rows to fit trees on")
    growing = [Growing(layout) for _ in range(trees)]
    # Nodes to split by passes, and nodes that one task finishes, with their level.
    large, small = [], []
    for t in range(trees):
        (large if size > task_rows else small).append((t, 0, 0))
    while large:
        level, following = large[0][2], []
        step = max(1, PASS_CELLS // max(layout.cells, 1))
        for begin in range(0, len(large), step):
            part = large[begin : begin + step]
            sums, totals = _forest_sums(blocks, layout, [(t, node) for t, node, _ in part], {t: growing[t].tree(level) for t, _, _ in part}, seed)
            for (t, node, _), total, split in zip(part, totals.T, best_splits(layout, sums, totals, least)):
                if not level:
                    growing[t].nodes[0][3] = float(total[1] / total[0])
                if split is None:
                    continue
                for child, rows in zip(growing[t].split(node, split), split.rows):
                    if level + 1 < depth:
                        (following if rows > task_rows else small).append((t, child, level + 1))
        large = following
    waves = []
    for begin in range(0, trees, WAVE_TREES):
        wave = range(begin, min(begin + WAVE_TREES, trees))
        part = [place for place in small if place[0] in wave]
        if part:
            waves.append(stage(_finished(blocks, layout, part, {t: growing[t].tree(depth) for t in wave}, depth, least, seed)))
    found = _joined(layout, growing, waves, blocks.sparkSession, depth)
    release(*waves)
    return found


def _forest_sums(blocks: DataFrame, layout: Layout, places: list[tuple[int, int]], tops: dict[int, Trees], seed: int) -> tuple[np.ndarray, np.ndarray]:
    by_tree = {t: np.array([node for other, node in places if other == t]) for t in tops}

    def make(batches):
        sums = {t: np.zeros((2, len(nodes), layout.cells)) for t, nodes in by_tree.items()}
        totals = {t: np.zeros((2, len(nodes))) for t, nodes in by_tree.items()}
        for block in _blocks(layout, batches):
            for t, nodes in by_tree.items():
                # Rows that were not drawn count nothing; to leave them out would copy the others, row by row.
                own = _node_sums(layout, [(block.rows, block.label, _times(block, t, seed))], tops[t], nodes)
                sums[t], totals[t] = sums[t] + own[0], totals[t] + own[1]
        return np.concatenate([np.concatenate([found[t] for t in by_tree], 1).ravel() for found in (sums, totals)])

    found, ends = _summed(blocks, make), 2 * len(places) * layout.cells
    return found[:ends].reshape(2, len(places), -1), found[ends:].reshape(2, -1)


FINISHED = "tree int, node int, column binary, cut binary, child binary, value binary, gains binary"


def _finished(blocks: DataFrame, layout: Layout, places: list[tuple[int, int, int]], tops: dict[int, Trees], depth: int, least: int, seed: int) -> DataFrame:
    """The parts of the trees below the given nodes."""
    levels = {(t, node): level for t, node, level in places}
    trees = sorted({t for t, _, _ in places})

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(layout, batches):
            for t in trees:
                weight = _times(block, t, seed)
                leaf = tops[t].leaves(layout, block.rows)
                for node in np.unique(leaf[weight > 0]):
                    if (t, int(node)) not in levels:
                        continue
                    mine = (leaf == node) & (weight > 0)
                    columns = [[t], [int(node)], [block.number], [block.rows[mine].tobytes()], [block.label[mine].tobytes()], [weight[mine].astype(np.uint8).tobytes()]]
                    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, types)], names=["tree", "node", "block", "rows", "label", "times"])

    kind = np.int32 if layout.values else np.uint8

    def finish(table: pa.Table) -> pa.Table:
        t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        table = table.sort_by("block")
        label, times = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in table.column(c)]) for c, k in (("label", float), ("times", np.uint8)))
        rows = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("rows")]).reshape(len(label), -1)
        tree, gains = grow_whole(layout, rows, label, times.astype(float), depth - levels[t, node], least)
        found = [tree.column, tree.cut, tree.child, tree.value, gains]
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("column", "cut", "child", "value", "gains"), found)}})

    dealt = blocks.mapInArrow(deal, "tree int, node int, block long, rows binary, label binary, times binary")
    return dealt.groupBy("tree", "node").applyInArrow(finish, FINISHED)


# A tree as a row of a stored frame, and its arrays.
STORED = "tree int, depth int, weight double, column binary, cut binary, child binary, value binary"
ARRAYS = {"column": np.int32, "cut": np.int32, "child": np.int32, "value": np.float64}


def as_row(number: int, tree: Trees, weight: float) -> tuple:
    """A tree as the values of STORED."""
    return (number, tree.depth, float(weight), *(bytearray(getattr(tree, c).astype(kind).tobytes()) for c, kind in ARRAYS.items()))


def of_row(row: Mapping) -> Trees:
    return Trees(*(np.frombuffer(row[c], kind) for c, kind in ARRAYS.items()), row["depth"])


def _whole(top: Growing, parts: list[Mapping], depth: int) -> tuple[Trees, np.ndarray]:
    """A top and the parts below it as one tree, and the features' gains."""
    tree, gains = top.tree(depth), top.gains.copy()
    for row in sorted(parts, key=lambda row: row["node"]):
        column, cut, child, value = (np.frombuffer(row[c], kind) for c, kind in ARRAYS.items())
        # The part's root takes the place of the node; its other nodes go to the end.
        node, shift = row["node"], len(tree.column) - 1
        moved = child + shift
        for name, mine in (("column", column), ("cut", cut), ("child", moved), ("value", value)):
            held = np.concatenate([getattr(tree, name), mine[1:]])
            held[node] = mine[0]
            setattr(tree, name, held)
        if child[0] == 0:
            tree.child[node] = node
        gains += np.frombuffer(row["gains"], float)
    return tree, gains


def _joined(layout: Layout, growing: list[Growing], waves: list[DataFrame], spark: SparkSession, depth: int) -> Ensemble:
    """The ensemble of the tops and the parts below them."""
    nodes = sum(len(top.nodes) for top in growing)
    for wave in waves:
        # The root of a part is a node of its top.
        nodes += wave.agg(F.sum(F.octet_length("column") / 4 - 1)).first()[0] or 0
    weight = 1.0 / len(growing)
    if nodes <= HELD_NODES:
        parts: dict[int, list] = {}
        for row in (row for wave in waves for row in wave.collect()):
            parts.setdefault(row["tree"], []).append(row)
        grown = [_whole(top, parts.get(t, []), depth) for t, top in enumerate(growing)]
        shares = sum(_shares(gains) for _, gains in grown)
        return Ensemble(layout, [tree for tree, _ in grown], [weight] * len(grown), _shares(shares))

    def join(table: pa.Table) -> pa.Table:
        t = table.column("tree")[0].as_py()
        tree, gains = _whole(growing[t], [row for row in table.to_pylist() if row["node"] >= 0], depth)
        row = [*as_row(t, tree, weight), _shares(gains).tobytes()]
        return pa.Table.from_pylist([dict(zip(schema.names, row))], pa.schema(list(zip(schema.names, types))))

    schema = T.StructType.fromDDL(f"{STORED}, gains binary")
    types = [pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 5]
    # Every tree has a row, also one without a part.
    rows = spark.createDataFrame([(t, -1, *[bytearray()] * 5) for t in range(len(growing))], FINISHED)
    for wave in waves:
        rows = rows.unionByName(wave)
    stored = stage(rows.groupBy("tree").applyInArrow(join, schema))
    shares = sum(np.frombuffer(row["gains"]) for row in stored.select("tree", "gains").orderBy("tree").collect())
    return Ensemble(layout, [], [], _shares(shares), stored.drop("gains"), int(nodes))


# --- scores of stored trees ----------------------------------------------------------


def score_stored(bins: DataFrame, ensemble: Ensemble) -> DataFrame:
    """(bins, prediction) of every distinct row of `bins` (a column `bins`, of `packed`), stored.

    Chunks of the rows meet parts of the trees in tasks of about `CHUNK_ROWS` rows and
    `PART_NODES` nodes; the sums of the parts are added up in order.
    """
    layout, rows = ensemble.layout, stage(bins.distinct())
    chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    parts = max(1, -(-ensemble.nodes // PART_NODES))
    trees = ensemble.stored.count()
    chunk = F.pmod(F.xxhash64("bins"), F.lit(chunks)).cast("int")
    left = rows.select("bins", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    part = F.floor(F.col("tree") * parts / F.lit(trees)).cast("int")
    right = ensemble.stored.withColumn("part", part).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def score(key: tuple, mine: pa.Table, own: pa.Table) -> pa.Table:
        held = [(of_row(row), row["weight"]) for row in own.sort_by("tree").to_pylist()]
        found = []
        for begin in range(0, len(mine), BLOCK_ROWS):
            slice_ = unpacked(layout, mine.column("bins")[begin : begin + BLOCK_ROWS])
            total = np.zeros(len(slice_))
            for tree, weight in held:
                total += weight * tree.predicted(layout, slice_)
            found.append(total)
        total = np.concatenate(found) if found else np.zeros(0)
        return pa.table({"bins": mine.column("bins"), "part": pa.array([key[1].as_py()] * len(mine), pa.int32()), "total": total})

    left, right = (side.groupBy("chunk", "part") for side in (left, right))
    totals = left.cogroup(right).applyInArrow(score, "bins binary, part int, total double")
    ordered = F.array_sort(F.collect_list(F.struct("part", "total")))
    total = F.aggregate(ordered, F.lit(0.0), lambda held, one: held + one["total"])
    found = stage(totals.groupBy("bins").agg(total.alias("prediction")))
    release(rows)
    return found


def packed(layout: Layout, values: np.ndarray, codes: np.ndarray) -> pa.Array:
    """The binned rows, each as the bytes of its bins and codes."""
    rows = np.concatenate([layout.binned(values), np.ascontiguousarray(codes, np.int32).view(np.uint8).reshape(len(values), -1)], 1)
    return pa.array([row.tobytes() for row in rows], pa.binary())


def unpacked(layout: Layout, column: pa.ChunkedArray) -> np.ndarray:
    """The rows that `packed` made bytes of, as trees read them."""
    dense = len(layout.cuts)
    held = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    if not layout.values:
        return held
    codes = np.ascontiguousarray(held[:, dense:]).view(np.int32)
    return np.concatenate([held[:, :dense].astype(np.int32), codes], 1)
