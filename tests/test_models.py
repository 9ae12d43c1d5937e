import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketwise.models import features as lists
from basketwise.models import store, training
from basketwise.operators import baskets, prepare
from basketwise.plans import jobs
from basketwise.session import stage
from basketwise.sources import star, tables
from tests.conftest import DATA


@pytest.fixture(scope="module")
def churn_frame(spark):
    rng = random.Random(1)
    rows = []
    for n in range(240):
        visits = rng.randrange(1, 30)
        region = ["v1.5", "it's", "new\\old", None][n % 4]
        rows.append((n, visits, float("inf") if n % 50 == 0 else visits * 2.0, None if n % 7 == 0 else rng.random(), region, n % 3, int(visits < 10)))
    columns = "hshd_num bigint, purchase_count int, total_spend double, total_units double, age_range string, children int, churned int"
    frame = spark.createDataFrame(rows, columns)
    rest = {c: F.col("purchase_count").cast("double") for c in lists.CHURN_NUMERIC if c not in frame.columns}
    return stage(frame.withColumns(rest))


@pytest.fixture(scope="module")
def trained(churn_frame):
    return training.train_churn(churn_frame, trees=3, depth=3)


def test_feature_names(trained):
    names = lists.feature_names(trained.model)
    assert names[:9] == lists.CHURN_NUMERIC
    assert sorted(names[9:]) == sorted(["children", "age_range_new\\old", "age_range_v1_5"])


def test_scores(spark, trained, churn_frame):
    scored = training.score_churn(trained.model, churn_frame)
    rows = scored.collect()
    assert len(rows) == 240 and all(0 <= r["churn_prob"] <= 1 for r in rows)
    hits = sum(r["prediction"] == r["churned"] for r in rows)
    assert hits > 220
    top = training.churn_risk(scored, 10).collect()
    assert len(top) == 10 and [r["churn_prob"] for r in top] == sorted((r["churn_prob"] for r in rows), reverse=True)[:10]
    importance = training.feature_importance(trained.model, 4, spark).collect()
    assert len(importance) == 4 and importance[0]["importance"] >= importance[-1]["importance"]


def test_same_seed_same_model(trained, churn_frame):
    again = training.train_churn(churn_frame, trees=3, depth=3)
    first, second = (
        {r["hshd_num"]: r["churn_prob"] for r in training.score_churn(t.model, churn_frame).collect()} for t in (trained, again)
    )
    assert first == second


def test_stored_model_scores_alike(trained, churn_frame, tmp_path):
    training.save_model(trained.model, str(tmp_path / "model"))
    loaded = training.load_model(str(tmp_path / "model"))
    assert lists.feature_names(loaded) == lists.feature_names(trained.model)
    difference = training.score_churn(trained.model, churn_frame).exceptAll(training.score_churn(loaded, churn_frame))
    assert difference.isEmpty()


def test_new_categories_give_zeros(trained, churn_frame):
    strange = churn_frame.limit(5).withColumn("age_range", F.lit("never seen"))
    assert training.score_churn(trained.model, strange).where(F.col("churn_prob").isNull()).isEmpty()


def test_jobs(spark, tmp_path):
    """The three jobs on the small test tables, and what they leave behind."""
    folder = str(tmp_path)
    data = star.load_tables(spark, DATA)
    for kind, frame in data.items():
        frame.write.parquet(f"{folder}/{kind}")
    loaded = tables.load_tables(spark, folder)
    churn = jobs.churn_job(loaded, folder, trees=2, depth=3)
    value = jobs.clv_job(loaded, folder, trees=3, depth=4)
    stats = tables.read_artifact(spark, folder, "customer_clv_stats")
    assert {"predicted_clv", "clv_tier", "dept_economy"} <= set(stats.columns)
    assert stats.count() == tables.read_artifact(spark, folder, "customer_churn_stats").count() == churn.data.count()
    assert "dept_economy" in lists.feature_names(value.model)
    rows = [(r["predicted_clv"], r["clv_tier_rank"]) for r in stats.select("predicted_clv", "clv_tier_rank").collect()]
    edges = np.percentile([value for value, _ in rows], [25, 50, 75])
    assert all(tier == sum(value > edges) for value, tier in rows)
    jobs.basket_tables(loaded, folder, n=50)
    top = tables.read_artifact(spark, folder, "top_product_pairs")
    assert top.groupBy("product1_num").count().where(F.col("count") > baskets.PER_PRODUCT).isEmpty()
    recommended = jobs.recommend_job(loaded, folder)
    best = recommended.groupBy(*baskets.BASKET).agg(F.max("score").alias("best"), F.min("score").alias("worst"))
    assert best.where((F.col("best") != 1.0) | (F.col("worst") <= 0)).isEmpty() and not best.isEmpty()
    pair = jobs.pair_model_job(loaded, folder, trees=2)
    names = lists.feature_names(pair.model)
    assert names[-3:] == lists.PAIR_COMBINED and "p1_avg_spend" in names and "p1_department" not in names
    assert training.score_pairs(pair.model, pair.test).where(F.col("prediction").isNull()).isEmpty()


def test_fitted_models_are_found_again(churn_frame, trained, tmp_path, monkeypatch):
    folder, fits = str(tmp_path), []

    def train(df, **settings):
        fits.append(settings)
        return training.train_churn(df, **settings)

    monkeypatch.setitem(store.KINDS, "churn", (train, training.split_churn))
    first = store.fitted(folder, "churn", churn_frame, trees=2, depth=2)
    again = store.fitted(folder, "churn", churn_frame.repartition(3).select("*"), trees=2, depth=2)
    assert len(fits) == 1
    scores = [training.score_churn(t.model, t.test).select("hshd_num", "churn_prob") for t in (first, again)]
    assert scores[0].exceptAll(scores[1]).isEmpty() and scores[0].count() == scores[1].count() > 0
    store.fitted(folder, "churn", churn_frame, trees=3, depth=2)
    changed = churn_frame.withColumn("children", F.when(F.col("hshd_num") == 5, F.lit(7)).otherwise(F.col("children")))
    store.fitted(folder, "churn", changed, trees=2, depth=2)
    assert len(fits) == 3


def test_a_column_of_thousands_of_values_is_trained_on(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for n in range(6_000):
        name = f"area {n % 2_900}"
        rows.append((n, rng.randrange(1, 30), name if n % 50 else None, int(n % 2_900 < 1_000 and n % 3 > 0)))
    frame = spark.createDataFrame(rows, "hshd_num bigint, purchase_count int, age_range string, churned int")
    rest = {c: F.col("purchase_count").cast("double") for c in lists.CHURN_NUMERIC if c not in frame.columns}
    found = training.train_churn(stage(frame.withColumns(rest)), trees=1, depth=2)
    names = lists.feature_names(found.model)
    scored = training.score_churn(found.model, found.test)
    vector = found.model.transform(found.test).select("features").first()[0]
    known = sorted(r.age_range for r in frame.select("age_range").dropna().distinct().collect())
    assert len(known) > 2_800 and len(names) == vector.size == 9 + len(known) - 1 and len(vector.indices) <= 10
    assert names[9:] == [f"age_range_{value}" for value in known[1:]]
    training.save_model(found.model, str(tmp_path / "model"))
    loaded = training.load_model(str(tmp_path / "model"))
    strange = found.test.withColumn("age_range", F.lit("never seen"))
    assert training.score_churn(loaded, strange).where("churn_prob is null").isEmpty() and 1_500 <= scored.count() <= 1_502


def test_trees_read_what_the_scaler_gives(trained, churn_frame):
    """The numbers for the trees are those of the stored pipeline's vector, to the last bit."""
    prepared = PipelineModel(trained.model.stages[:-1])
    rows = prepared.transform(churn_frame).select(training._scaled(prepared), vector_to_array(F.col("features")).alias("vector")).collect()
    assert len(rows) == 240 and all(r["values"] == r["vector"] for r in rows)


def test_a_split_stores_no_row_again(spark, churn_frame, monkeypatch):
    """Only the ends of the held-out part are stored, one for each label; the parts are those of `mark_split`."""
    sizes = []

    def store(df):
        copy = stage(df)
        sizes.append(copy.count())
        return copy

    monkeypatch.setattr(training, "stage", store)
    data, test, rest = training._split(churn_frame, "hshd_num", training.CHURN_LABEL, False)
    marked = {r["hshd_num"]: r["is_test"] for r in prepare.mark_split(churn_frame, "hshd_num", training.CHURN_LABEL).collect()}
    assert sizes == [2] and data.count() == len(marked) == 240
    assert {r["hshd_num"] for r in test.collect()} == {n for n, held_out in marked.items() if held_out}
    assert {r["hshd_num"] for r in rest.collect()} == {n for n, held_out in marked.items() if not held_out}
