"""Fitted models found again by their data and settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise import batches
from basketwise.models import training

# What each kind of model is fitted by, and how its rows are split.
KINDS: dict[str, tuple[Callable[..., training.Trained], Callable[[DataFrame], tuple[DataFrame, DataFrame]]]] = {
    "churn": (training.train_churn, training.split_churn),
    "clv": (training.train_clv, training.split_clv),
    "pair": (training.train_pair_model, training.split_pairs),
}


def fingerprint(df: DataFrame, **settings) -> str:
    """A name of the rows of `df`, in any order, its columns and some settings."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns])
    parts = [F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(2_147_483_647)))]
    held = df.agg(*[part.alias(f"p{i}") for i, part in enumerate(parts)]).first()
    text = json.dumps([df.schema.jsonValue(), list(held), settings], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def fitted(folder: str, kind: str, df: DataFrame, **settings) -> training.Trained:
    """The model of `kind` for the stored frame `df`: loaded if it has been fitted to such data and settings, else fitted and stored.

    Models are stored whole or not at all, so any job may look for one; of two jobs that
    fit the same one, one stores it. Other rows or settings have models of their own.
    """
    train, split = KINDS[kind]
    name = f"{kind}-{fingerprint(df, **settings)}"
    found = batches.find(df.sparkSession, folder, name)
    if found is not None:
        return training.Trained(training.load_model(found.path(folder, "model")), *split(df))
    trained = train(df, **settings)

    def write(place: str) -> dict:
        training.save_model(trained.model, f"{place}/model")
        return {}

    batches.store(df.sparkSession, folder, name, write)
    return trained
