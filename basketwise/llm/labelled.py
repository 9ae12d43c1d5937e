"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.llm.text import text_or_empty

# Labelled rows that a classifier is fitted on at most; those of the smallest hash of doc_id.
MOST_LABELLED = 20_000


def held_out(number: Column) -> Column:
    """One fifth of all documents, by the crc32 of their number as text."""
    return F.coalesce(F.crc32(number.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(labelled_id, label), one row for each document; rows without a number or label are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col(label).cast("int").alias("label"))
    return known.where("labelled_id is not null and label is not null").groupBy("labelled_id").agg(F.max("label").alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, without_held_out: bool = False) -> DataFrame:
    """(text, label) of at most `most` labelled documents; rows without a number or label are left out."""
    known = known_labels(labels, label)
    if without_held_out:
        known = known.where(~held_out(F.col("labelled_id")))
    chosen = known.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("labelled_id"), text_or_empty().alias("text"))
    # At most `most` rows of two numbers.
    return texts.join(F.broadcast(chosen), "labelled_id").select("labelled_id", "text", "label")
