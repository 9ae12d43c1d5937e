import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from basketwise.models import trees
from basketwise.models.ensembles import TreesModel, numbers
from basketwise.session import STAGED, stage

ROWS = 2_000


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(ROWS, 4))
    values[:, 3] = rng.integers(0, 3, ROWS)
    label = values[:, 0] ** 2 + values[:, 1] * (values[:, 3] == 1) + rng.normal(size=ROWS) / 5
    rows = [(n, *map(float, row), float(y)) for n, (row, y) in enumerate(zip(values, label))]
    found = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double").repartition(3, "id")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(found).cache()


@pytest.fixture(scope="module")
def blocks(frame):
    rows = frame.select(numbers("features"), F.array().cast("array<int>").alias("codes"), F.col("y").alias("label"))
    layout = trees.Layout(trees.find_cuts(rows, 4))
    return trees.store_blocks(rows, layout), layout


def scores(frame, ensemble):
    return dict(TreesModel(ensemble).transform(frame).select("id", "prediction").collect())


def test_boosted_trees_are_those_of_spark(frame, blocks):
    own = trees.boost(*blocks, "squared", 8, 0.1, 3, 5)
    fitted = GBTRegressor(labelCol="y", maxIter=8, stepSize=0.1, maxDepth=3, minInstancesPerNode=5).fit(frame)
    expected = dict(fitted.transform(frame).select("id", "prediction").collect())
    found = scores(frame, own)
    assert len(found) == ROWS and max(abs(found[n] - expected[n]) for n in expected) < 1e-9
    assert np.allclose(own.importances, fitted.featureImportances.toArray())


def test_passes_over_all_rows_give_the_trees_of_one_task(frame, blocks):
    one, many = (scores(frame, trees.boost(*blocks, "squared", 12, 0.1, 3, 5, most)) for most in (ROWS, 0))
    assert max(abs(one[n] - many[n]) for n in one) < 1e-9


def test_scores_are_stored_after_many_trees_only(frame, blocks, monkeypatch):
    """The scores are kept with the blocks in memory; copies are rare, give the same trees and do not stay."""
    stored, held = [], set(STAGED.get(frame.sparkSession, []))
    monkeypatch.setattr(trees, "stage", lambda df: stored.append(1) or stage(df))
    one, many = (scores(frame, trees.boost(*blocks, "squared", 12, 0.1, 3, 5, most)) for most in (ROWS, 0))
    assert not stored
    monkeypatch.setattr(trees, "COPY_TREES", 4)
    copied = scores(frame, trees.boost(*blocks, "squared", 12, 0.1, 3, 5, 0))
    assert len(stored) == 2 and set(STAGED[frame.sparkSession]) == held
    assert max(max(abs(one[n] - many[n]), abs(one[n] - copied[n])) for n in one) < 1e-9


def test_rows_of_other_nodes_are_not_counted():
    """Whether few or many rows lie elsewhere, the sums are those of the nodes' own rows."""
    rng = np.random.default_rng(3)
    layout = trees.Layout([np.arange(7.0), np.arange(3.0)], [5])
    for size in (200, 3_000):
        rows = np.stack([rng.integers(0, 8, size), rng.integers(0, 4, size), rng.integers(0, 6, size)], 1).astype(np.int32)
        target, weight = rng.normal(size=size), rng.poisson(1.0, size).astype(float)
        for cut in (0, 5):
            tree = trees.Trees(np.zeros(3, np.int32), np.array([cut, 0, 0], np.int32), np.array([1, 1, 2], np.int32), np.zeros(3), 1)
            own = rows[:, 0] <= cut
            for times in (None, weight):
                sums, totals = trees._node_sums(layout, [(rows, target, times)], tree, np.array([1]))
                mine = None if times is None else times[own]
                assert np.array_equal(sums, trees.cells(layout, rows[own], target[own], mine))
                assert totals[0, 0] == (own.sum() if times is None else mine.sum())


def test_columns_counted_in_pairs_give_the_same_sums():
    """Numbers in pairs of columns, an odd one and coded columns alone; of equal columns the first is split by."""
    rng = np.random.default_rng(4)
    for widths in ([7, 3, 5], [7, 3], [31], []):
        layout = trees.Layout([np.arange(float(n)) for n in widths], [5])
        rows = np.stack([*[rng.integers(0, n + 1, 3_000) for n in widths], rng.integers(0, 6, 3_000)], 1).astype(np.int32)
        target, place = rng.normal(size=3_000), rng.integers(0, 3, 3_000)
        for weight in (None, rng.poisson(1.0, 3_000).astype(float)):
            for where, nodes in ((None, 1), (place, 3)):
                one, two = (trees.cells(layout, rows, target, weight, where, nodes, paired) for paired in (False, True))
                assert np.array_equal(one[0], two[0]) and np.allclose(one[1], two[1], rtol=1e-12, atol=1e-12)
    layout = trees.Layout([np.arange(7.0)] * 3)
    column = rng.integers(0, 8, 3_000)
    rows = np.stack([rng.integers(0, 8, 3_000), column, column], 1).astype(np.uint8)
    sums = trees.cells(layout, rows, target + (column > 3), paired=True)
    totals = np.array([[3_000.0], [(target + (column > 3)).sum()]])
    sums[1, 0, 8:16] *= 1 - 1e-15
    assert trees.best_splits(layout, sums, totals, 1, True)[0].cell // 8 == 1


def test_large_nodes_of_a_forest_are_split_by_passes(frame, blocks):
    whole, parted = (trees.forest(*blocks, 6, 7, 5, 3, most) for most in (ROWS, 300))
    first, second = scores(frame, whole), scores(frame, parted)
    assert max(abs(first[n] - second[n]) for n in first) < 1e-9
    assert np.allclose(whole.importances, parted.importances) and abs(whole.importances.sum() - 1) < 1e-9
    truth = dict(frame.select("id", "y").collect())
    errors, spread = [first[n] - truth[n] for n in truth], list(truth.values())
    assert np.var(errors) < np.var(spread) / 4


def test_a_large_forest_is_stored_and_scored_in_parts(frame, blocks, monkeypatch, tmp_path):
    """Its trees do not come to the driver, when fitted, stored, loaded or scored; scores are those of held trees."""
    rows = frame.unionByName(frame.limit(5))
    held = [trees.forest(*blocks, 6, 7, 5, 3, most) for most in (ROWS, 300, 1)]
    for name, value in (("HELD_NODES", 0), ("PART_NODES", 200), ("CHUNK_ROWS", 700)):
        monkeypatch.setattr(trees, name, value)
    for whole, most in zip(held, (ROWS, 300, 1)):
        stored = trees.forest(*blocks, 6, 7, 5, 3, most)
        assert not stored.trees and stored.stored.count() == 6 and stored.nodes == sum(len(t.child) for t in whole.trees)
        assert np.allclose(whole.importances, stored.importances, rtol=1e-12)
        TreesModel(stored).write().save(f"{tmp_path}/{most}")
        loaded = TreesModel.load(f"{tmp_path}/{most}")
        assert not loaded.ensemble.trees
        expected = scores(frame, whole)
        for model in (TreesModel(stored), loaded):
            found = model.transform(rows).select("id", "prediction").collect()
            assert len(found) == ROWS + 5 and max(abs(p - expected[n]) for n, p in found) < 1e-12
        assert not TreesModel(stored).transform(frame.where("id < 0")).count()


def test_coded_columns_are_read_from_packed_rows():
    layout = trees.Layout([np.array([0.5]), np.array([1.0, 2.0])], [300])
    values, codes = np.array([[0.0, 3.0], [1.0, 1.5]]), np.array([[299], [7]])
    assert trees.unpacked(layout, trees.packed(layout, values, codes)).tolist() == [[0, 2, 299], [1, 1, 7]]


def test_cuts_come_from_all_rows_beyond_the_sketch(spark):
    """A few rows of a value above all others are seen however many rows there are."""
    df = spark.range(200_000, numPartitions=2).select(
        F.array((F.col("id") % 150_000).cast("double"), (F.col("id") >= 199_990).cast("double")).alias("values"),
        F.array().cast("array<int>").alias("codes"),
        F.lit(1.0).alias("label"),
    )
    wide, rare = trees.find_cuts(df, 2)
    assert list(rare) == [0.5] and len(wide) == trees.BINS - 1
    values = np.sort(np.arange(200_000) % 150_000)
    wanted = values[np.arange(1, trees.BINS) * 200_000 // trees.BINS]
    assert max(abs(wide - wanted)) < 150_000 * 2 / trees.SKETCH_VALUES


def test_missing_labels_are_refused(spark, blocks):
    with pytest.raises(ValueError):
        trees.boost(blocks[0].where("rows < 0"), blocks[1], "squared", 2, 0.1, 3, 5)


def test_stored_blocks_are_those_that_are_kept(spark):
    """Numbers, coded columns, labels and scores of a kept block come back as they were, without a join."""
    layout = trees.Layout([np.arange(3.0), np.arange(2.0)], [70_000])
    rng = np.random.default_rng(6)
    frame = spark.createDataFrame(
        [([float(a), float(b)], [int(c)], float(y)) for a, b, c, y in zip(rng.integers(0, 4, 300), rng.integers(0, 3, 300), rng.integers(0, 70_000, 300), rng.normal(size=300))],
        trees.VALUES,
    )
    blocks = trees.store_blocks(frame.repartition(3, "label"), layout)
    tree = trees.Trees(np.array([0, 0, 0], np.int32), np.array([1, 0, 0], np.int32), np.array([1, 1, 2], np.int32), np.array([0.0, 1.5, -2.0]), 1)
    state = trees._with_scores(trees._kept(blocks, layout, 2), layout, tree, 0.5)
    again = trees._kept(trees._stored(blocks, state, layout), layout, 2)
    one, two = ({b.number: b for b in kept.collect()} for kept in (state, again))
    assert one.keys() == two.keys() and sum(len(b.rows) for b in two.values()) == 300
    for number, block in one.items():
        for part in ("rows", "label", "score"):
            assert np.array_equal(getattr(block, part), getattr(two[number], part))
    assert {score for b in two.values() for score in b.score} == {0.75, -1.0}


def test_sorted_lists_are_merged_as_by_sorting_anew():
    rng = np.random.default_rng(8)
    for size in (0, 1, 5, 4_000):
        parts = [np.unique(rng.integers(0, 900, size) / 7) for _ in range(3)]
        values = np.concatenate([*parts, [np.nan] * min(size, 2)])
        counts = rng.integers(1, 50, len(values))
        found, place = np.unique(values, return_inverse=True)
        own, sums = trees._merged(values, counts)
        assert np.array_equal(own, found, equal_nan=True) and np.array_equal(sums, np.bincount(place, counts, len(found)))
