"""A corpus pipeline of stages, each written as Parquet and read again for the next.

Documents are judged, cleaned of near copies and of benchmark passages, and packed. The
first four stages keep all columns of the documents; the last gives the pieces of the
packed sequences.

Null and empty texts fail the plain quality rules and go with the first stage, as do all
of fewer than 50 words. Rows that repeat a doc_id stay or go together; a row without
doc_id is judged by its text, but no near copy or benchmark passage takes it out. Other
columns, whatever their names, pass through. Without labels only the plain rules take
documents out, without benchmark items no passage does; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketwise.llm import decontamination, jaccard_join, packing, quality, toxicity
from basketwise.llm.text import table
from basketwise.session import release, stage_alone

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules or the isolation forest reject go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.harmless_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)
    return pieces.select(*[c for c in pieces.columns if c != "ids"], F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed_sequences),
]
# The trained stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a folder; every result but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    *stored, (_, last) = STAGES
    for number, (_, step) in enumerate(stored):
        kept = stage_alone(spark, lambda: step(spark, docs, sf_dir))
        if number:
            release(docs)
        docs = kept
    return last(spark, docs, sf_dir)
