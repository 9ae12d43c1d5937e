import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketwise.operators import metrics, prepare, ranking, sketches
from tests.conftest import as_dicts


def frame_of(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"hshd_num bigint, {name} double")


@pytest.fixture(scope="module")
def numbers():
    """A third of the values are one and the same."""
    rng = random.Random(3)
    values = [rng.gauss(100, 40) for _ in range(400)] + [50.0] * 200
    rng.shuffle(values)
    return values


@pytest.mark.parametrize("ranges", [2, 5, 64])
def test_exact_quantiles(spark, numbers, ranges):
    wanted = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = ranking.exact_quantiles(frame_of(spark, numbers + [None, float("nan")]), "v", wanted, ranges)
    assert found["n"] == [600]
    assert found["q"] == pytest.approx(np.quantile(numbers, wanted).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert ranking.exact_quantiles(frame_of(spark, [None]), "v", [0.5])["q"] == [None]
    assert ranking.exact_quantiles(frame_of(spark, [4.0]), "v", [0.5])["q"] == [4.0]


def test_tiers(spark):
    rows = metrics.clv_tiers(frame_of(spark, [1.0, 2.0, 3.0, 10.0, None]), "v").orderBy("hshd_num").collect()
    assert [r["clv_tier"] for r in rows] == ["Bronze", "Silver", "Gold", "Platinum", None]
    edges = ranking.exact_quantiles(frame_of(spark, [1.0, 2.0, 3.0, 10.0]), "v", [0.25, 0.5, 0.75])["q"]
    assert edges == [1.75, 2.5, 4.75]


def test_tiers_with_ties(spark):
    same = frame_of(spark, [5.0] * 4)
    assert {r["clv_tier"] for r in metrics.clv_tiers(same, "v").collect()} == {"Bronze"}
    with pytest.raises(ValueError, match="coincide"):
        metrics.clv_tiers(same, "v", raise_on_ties=True)


@pytest.mark.parametrize("values", [[5.0, 5.0], [float(n) for n in range(11)], [0.1 * n for n in range(31)]])
def test_histogram_like_numpy(spark, values):
    counts, edges = np.histogram(values, bins=10)
    rows = metrics.clv_histogram(frame_of(spark, values), "v").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["low"] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert rows[0]["label"] == f"{int(edges[0])}-{int(edges[1])}"


def test_histogram_of_many_values(spark, numbers):
    counts, _ = np.histogram(numbers, bins=10)
    assert [r["count"] for r in metrics.clv_histogram(frame_of(spark, numbers), "v").collect()] == counts.tolist()


def test_correlations(spark):
    frame = spark.createDataFrame(
        [(1, 1.0, 5.0, None), (0, 2.0, 5.0, 1.0), (1, 4.0, 5.0, 2.0), (0, 3.0, 5.0, None)],
        "churned int, a double, constant double, sparse double",
    )
    found = {r["feature"]: r["correlation"] for r in metrics.churn_correlations(frame, ["a", "constant", "sparse"]).collect()}
    assert found["constant"] is None
    assert found["a"] == pytest.approx(np.corrcoef([1, 0, 1, 0], [1, 2, 4, 3])[0, 1])
    assert found["sparse"] == pytest.approx(1.0)


@pytest.mark.parametrize("ranges", [2, 64])
def test_auc(spark, ranges):
    rng = random.Random(5)
    rows = [(rng.randrange(2), float(rng.randrange(12))) for _ in range(300)] + [(0, 4.0)] * 150
    wins = pairs = 0
    for label, score in rows:
        for other, below in rows:
            if label == 1 and other == 0:
                pairs += 1
                wins += 1.0 if score > below else 0.5 if score == below else 0.0
    found = metrics.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s", ranges).first()["auc"]
    assert found == pytest.approx(wins / pairs)


def test_auc_of_one_class_is_unknown(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()["auc"] is None


def test_classification_report(spark):
    frame = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)], "y int, p int")
    cells = {(r["label"], r["prediction"]): r["count"] for r in metrics.confusion_matrix(frame, "y", "p").collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    rows = {r["class"]: r for r in as_dicts(metrics.classification_report(frame, "y", "p"))}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"], rows["1"]["support"]) == (1.0, 2 / 3, 0.8, 3)
    assert rows["0"]["precision"] == 2 / 3 and rows["accuracy"]["f1"] == 0.8
    assert rows["macro avg"]["recall"] == pytest.approx((1 + 2 / 3) / 2)
    never = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    assert {r["class"]: r["precision"] for r in metrics.classification_report(never, "y", "p").collect()}["1"] == 0.0


def test_regression_metrics(spark):
    truth, guess = [1.0, 2.0, 4.0], [1.5, 2.0, 3.0]
    row = metrics.regression_metrics(spark.createDataFrame(list(zip(truth, guess)), "y double, p double"), "y", "p").first()
    error = np.subtract(truth, guess)
    assert row["mse"] == pytest.approx(np.mean(error**2)) and row["rmse"] == pytest.approx(np.mean(error**2) ** 0.5)
    assert row["mae"] == pytest.approx(np.mean(np.abs(error)))
    assert row["r2"] == pytest.approx(1 - np.sum(error**2) / np.sum((truth - np.mean(truth)) ** 2))


def test_split_is_whole_disjoint_and_repeatable(spark):
    frame = spark.range(-50, 1000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    train, test = prepare.split(frame, "k", "y")
    kept, held = {r["k"] for r in train.collect()}, {r["k"] for r in test.collect()}
    assert not kept & held and len(kept | held) == 1050
    per_class = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    sizes = {r["y"]: r["count"] for r in frame.groupBy("y").count().collect()}
    assert per_class == {y: -(-n // 4) for y, n in sizes.items()}
    again = {r["k"] for r in prepare.split(frame.repartition(7), "k", "y")[1].collect()}
    assert again == held


def test_split_takes_the_smallest_hashes(spark):
    keys = [3, 17, 2**31 + 5, 2**40, -9, 0, 123456789012]
    marked = {r["k"]: r["is_test"] for r in prepare.mark_split(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k").collect()}
    order = sorted(keys, key=lambda k: ((k % 2**31) * 2654435761 % 2**32, k))
    assert {k for k, t in marked.items() if t} == set(order[:2])


def test_split_keeps_rows_without_a_key(spark):
    rows = [(None if k % 2 else k, "half") for k in range(40)] + [(None, "none")] * 3 + [(k, None) for k in range(8)]
    marked = prepare.mark_split(spark.createDataFrame(rows, "k bigint, y string"), "k", "y").collect()
    assert len(marked) == len(rows) and all(r["is_test"] in (0, 1) for r in marked)
    assert not any(r["is_test"] for r in marked if r["k"] is None)
    held = [r["y"] for r in marked if r["is_test"]]
    assert held.count("half") == 5 and held.count(None) == 2 and len(held) == 7


def test_binned_auc_is_within_its_bound(spark):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 3_000)
    score = np.round(rng.normal(truth, 1.5), 3)
    frame = spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, score)] + [(1, None), (0, float("nan"))], "y int, s double")
    exact = metrics.roc_auc(frame, "y", "s").first()["auc"]
    last = 1.0
    for bins in (1, 4, 50, 10_000):
        row = metrics.roc_auc_binned(frame, "y", "s", bins).first()
        assert abs(row["auc"] - exact) <= row["bound"] + 1e-12 and row["bound"] <= last
        last = row["bound"]
    assert last < 0.001
    assert metrics.roc_auc_binned(frame.where("y = 1"), "y", "s").first()["auc"] is None


def test_sketches_merge(spark, lines):
    rows = [(h, b, f"2018-{m:02d}-01", p, 1, 1, "r") for h in (1, 2) for m in (1, 2, 3) for b in range(40 * h) for p in (b % 7, m)]
    rows += [(None, 1, "2018-01-01", 1, 1, 1, "r"), (1, None, "2018-01-05", None, 1, 1, "r")]
    stored = sketches.monthly_sketches(lines(rows))
    assert stored.count() == 6
    found = {r["hshd_num"]: tuple(r)[1:] for r in sketches.merged_counts(stored, date(2018, 1, 15), date(2018, 2, 1)).collect()}
    assert found == {1: (161, 40, 7), 2: (320, 80, 7)}


def test_wide_one_hot_vectors(spark):
    frame = spark.range(60_000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("it's \\ "), F.col("id") % 50_000)).alias("c")
    )
    encoded, model = prepare.one_hot_vector(frame, ["c", "n"], dummy_na=True)
    names = prepare.vector_names(model)
    values = frame.select("c").dropna().distinct().count()
    assert len(names) == values and names[-1] == "c_nan" and values > 45_000
    first = frame.agg(F.min("c")).first()[0]
    for row in encoded.where("n in (0, 1, 55, 59999)").join(frame, "n").collect():
        held = [names[k] for k in row["encoded"].indices]
        assert held == (["c_nan"] if row["c"] is None else [] if row["c"] == first else [f"c_{row['c']}"])
    unseen = model.transform(spark.createDataFrame([("new", 1)], "c string, n long")).first()
    assert len(unseen["encoded"].indices) == 0


def test_one_hot(spark):
    frame = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("it's", 4)], "c string, n int")
    rows = as_dicts(prepare.one_hot(frame, ["c", "n"]).orderBy("n"))
    assert rows[0] == {"n": 1, "c_b": 1, "c_it's": 0} and rows[2] == {"n": 3, "c_b": 0, "c_it's": 0}
    full = prepare.one_hot(frame, ["c"], drop_first=False, dummy_na=True)
    assert full.columns == ["n", "c_a", "c_b", "c_it's", "c_nan"]
    with pytest.raises(ValueError, match="categories"):
        prepare.categories(frame, ["c"], limit=2)


def test_standardize(spark):
    frame = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (None, 1.0)], "x double, flat double")
    rows = prepare.standardize(frame, ["x", "flat"]).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_clean_and_impute(spark):
    frame = spark.createDataFrame([(float("inf"),), (float("nan"),), (2.0,), (4.0,), (None,)], "x double")
    cleaned = prepare.clean_features(frame, ["x"])
    assert [r["x"] for r in cleaned.collect()] == [None, None, 2.0, 4.0, None]
    assert [r["x"] for r in prepare.impute_mean(cleaned, ["x"]).collect()] == [3.0, 3.0, 2.0, 4.0, 3.0]
    assert [r["x"] for r in prepare.clean_features(frame, ["x"], fill_zero=True).collect()] == [0.0, 0.0, 2.0, 4.0, 0.0]
