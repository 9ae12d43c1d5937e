"""The three training jobs: tables in, model and result tables out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from basketwise.models import training
from basketwise.operators import baskets, customers
from basketwise.session import stage
from basketwise.sinks import write_artifact

Tables = Mapping[str, DataFrame]


def churn_job(tables: Tables, folder: str, **settings) -> training.Trained:
    """Train, score every household, store model and customer_churn_stats."""
    features = stage(customers.churn_features(tables["transactions"], tables["households"]))
    trained = training.train_churn(features, **settings)
    training.save_model(trained.model, f"{folder}/churn_model")
    write_artifact(training.score_churn(trained.model, trained.data), folder, "customer_churn_stats")
    return trained


def clv_job(tables: Tables, folder: str, **settings) -> training.Trained:
    """Train, score and tier every household, store model and customer_clv_stats."""
    features = stage(customers.clv_features(tables["transactions"], tables["products"], tables["households"]))
    trained = training.train_clv(features, **settings)
    training.save_model(trained.model, f"{folder}/clv_model")
    write_artifact(training.score_clv(trained.model, trained.data), folder, "customer_clv_stats")
    return trained


def basket_tables(tables: Tables, folder: str, n: int = baskets.TOP_PAIRS) -> None:
    """Store the top pairs, product details, recommendations and top product pairs."""
    pairs = stage(baskets.top_pairs(tables["transactions"], n))
    details = stage(baskets.product_details(pairs, tables["transactions"], tables["products"]))
    recs = stage(baskets.recommendations(pairs))
    write_artifact(pairs, folder, "top_pairs")
    write_artifact(details, folder, "product_details")
    write_artifact(recs, folder, "recommendations")
    write_artifact(baskets.top_product_pairs(recs, details), folder, "top_product_pairs")


def pair_model_job(tables: Tables, folder: str, **settings) -> training.Trained:
    """Train the pair-strength model on all pairs and store it."""
    pairs = stage(baskets.basket_pairs(tables["transactions"]))
    stats = stage(baskets.product_stats(tables["transactions"], tables["products"]))
    trained = training.train_pair_model(stage(baskets.pair_features(pairs, stats)), **settings)
    training.save_model(trained.model, f"{folder}/basket_model")
    return trained


def recommend_job(tables: Tables, folder: str, exclude_owned: bool = False) -> DataFrame:
    """Recommendations for every basket, a household's basket number, from the stored tables."""
    from basketwise.sources.tables import read_artifact

    spark = tables["transactions"].sparkSession
    lines = tables["transactions"].select(*baskets.BASKET, "product_num")
    recs, details = (read_artifact(spark, folder, name) for name in ("recommendations", "product_details"))
    return baskets.recommend(lines, recs, details, exclude_owned, baskets.BASKET)
