"""Token counts as rollups that signed deltas maintain.

A store is a folder. A batch of changes is summed to one signed row per source, language
and tokenizer version and committed by its name, whole or not at all
(`basketwise.batches`). Committing a name again changes nothing, a write that died is
replaced, and of two writers of one name one wins. Totals are the sum of all committed
deltas, so neither documents nor earlier batches are read again.

`compact` sums the batches so far into a base, which remembers their names; only batches
after it are listed and summed one by one.

Counts are numbers of ids of public tokenizers. Every document is encoded once for each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketwise import batches
from basketwise.llm.text import in_batches, text_or_empty
from basketwise.llm.tokens import encoder
from basketwise.session import stage

KEYS = ["source", "lang", "tokenizer_version"]
MEASURES = ["documents", "tokens"]
DELTAS = "source string, lang string, tokenizer_version string, documents long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """One additive row per source, language and tokenizer version of a batch of changes.

    `changes` has op, source, lang, tokenizer_version, tokens and, for revisions,
    old_version and old_tokens. An insert adds a document and its tokens, a delete takes
    them away, a revision takes the old count from the old version and adds the new one;
    without an old version it is that of the same version. Null keys are groups of their
    own, null counts are zero, repeated rows are changes of their own, and rows of
    another op are refused. Rows are summed before the shuffle, so a hot source moves a
    few rows for each task. Other columns are not read.
    """
    known = F.col("op").isin(INSERT, DELETE, REVISE)
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))).cast("int")
    sign = F.when(F.coalesce(known, F.lit(False)), F.when(F.col("op") == DELETE, -1).otherwise(1)).otherwise(unknown)
    tokens, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
    now = F.struct(F.col("tokenizer_version"), sign.cast("long").alias("documents"), (sign * tokens).alias("tokens"))
    before = F.struct(
        F.coalesce("old_version", "tokenizer_version").alias("tokenizer_version"),
        F.lit(-1).cast("long").alias("documents"),
        (-old).alias("tokens"),
    )
    rows = F.when(F.col("op") == REVISE, F.array(now, before)).otherwise(F.array(now))
    signed = changes.select("source", "lang", F.explode(rows).alias("r")).select("source", "lang", "r.*")
    return signed.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])


class RollupStore:
    """Totals by source, language and tokenizer version in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.bases = f"{self.path}/bases"

    def _base(self) -> batches.Batch | None:
        found = batches.committed(self.spark, self.bases)
        return found[-1] if found else None

    def _compacted(self, base: batches.Batch | None) -> DataFrame:
        """The names of the batches in a base."""
        if base is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(base.path(self.bases, "names"))

    def _later(self, base: batches.Batch | None) -> list[batches.Batch]:
        """The committed batches that are not in the base; not more than were added since it."""
        found = batches.committed(self.spark, self.path)
        listed = self.spark.createDataFrame([(batch.name,) for batch in found], "batch string")
        inside = {row["batch"] for row in self._compacted(base).join(F.broadcast(listed), "batch", "left_semi").collect()}
        return [batch for batch in found if batch.name not in inside]

    def committed(self) -> list[str]:
        """Names of the batches that count."""
        base = self._base()
        return sorted([row["batch"] for row in self._compacted(base).collect()] + [batch.name for batch in self._later(base)])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, with nothing read or written, if its name is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        base = self._base()
        if base is not None and not self._compacted(base).where(F.col("batch") == batch).isEmpty():
            return False
        writer = uuid.uuid4().hex

        def write(folder: str) -> dict:
            signed_deltas(changes).write.parquet(f"{folder}/deltas")
            return {"writer": writer}

        return batches.store(self.spark, self.path, batch, write).notes["writer"] == writer

    def _summed(self, base: batches.Batch | None, later: list[batches.Batch]) -> DataFrame:
        paths = [batch.path(self.path, "deltas") for batch in later]
        paths += [base.path(self.bases, "totals")] if base is not None else []
        if not paths:
            return self.spark.createDataFrame([], DELTAS)
        deltas = self.spark.read.schema(DELTAS).parquet(*paths)
        summed = deltas.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        return summed.where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """Documents and tokens of every key that is not down to nothing."""
        base = self._base()
        return self._summed(base, self._later(base))

    def compact(self) -> int:
        """Sum all committed batches into a new base and delete their folders; returns how many they are.

        The base appears whole or not at all, and batches that are committed meanwhile stay
        beside it. Frames of totals read before stop working.
        """
        base = self._base()
        later = self._later(base)
        if not later:
            return 0
        number = int(base.name) + 1 if base is not None else 1
        writer = uuid.uuid4().hex

        def write(folder: str) -> dict:
            self._summed(base, later).write.parquet(f"{folder}/totals")
            names = self.spark.createDataFrame([(batch.name,) for batch in later], "batch string")
            self._compacted(base).unionByName(names).write.parquet(f"{folder}/names")
            return {"writer": writer}

        done = batches.store(self.spark, self.bases, f"{number:012d}", write)
        if done.notes["writer"] != writer:
            return 0
        for batch in later:
            batches.remove(self.spark, self.path, batch)
        if base is not None:
            batches.remove(self.spark, self.bases, base)
        return len(later)


def counted_documents(docs: DataFrame, tokenizers: Mapping[str, str]) -> DataFrame:
    """(row, doc_id, source, lang, content, <version>...) of every document, stored: its counts by each tokenizer.

    `tokenizers` gives the file of each version. Texts are read whole, a null one as empty;
    content is 128 bits of its SHA-256. Rows are numbered, so repeated ones are told apart.
    """
    versions = list(tokenizers)

    @F.arrow_udf("struct<" + ", ".join(f"`{v}`: bigint" for v in versions) + ">")
    def count(texts: pa.Array) -> pa.Array:
        sizes = [np.fromiter((len(ids) for ids in encoder(tokenizers[v]).encode(texts)), np.int64, len(texts)) for v in versions]
        return pa.StructArray.from_arrays([pa.array(s) for s in sizes], versions)

    content = F.substring(F.unhex(F.sha2(text_or_empty().cast("binary"), 256)), 1, 16).alias("content")
    number = F.monotonically_increasing_id().alias("row")
    rows = docs.select(number, F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", content, count(text_or_empty()).alias("counts"))
    return stage(in_batches(rows).select("row", "doc_id", "source", "lang", "content", "counts.*"))


def copies_of(counted: DataFrame) -> DataFrame:
    """The rows that repeat a text: of each content all but the row of the smallest doc_id, null last, and smallest number.

    The row that stays is found by an aggregation, and the others by their own number, so
    the copies of one text never meet in one task.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = counted.groupBy("content").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return counted.join(kept, "row", "left_anti")


def document_changes(docs: DataFrame, tokenizers: Mapping[str, str]) -> dict[str, DataFrame]:
    """Batches of changes from a table of documents, in order; `tokenizers` gives the file of each version, old ones first.

    "load" inserts every document with its count by the first version; "recount-<version>"
    revises every one to the next version; "dedupe" deletes the copies of equal texts, also
    rows that repeat a doc_id or have none (`copies_of`). Null and empty texts are one text.
    """
    counted = counted_documents(docs, tokenizers)
    versions = list(tokenizers)
    nothing = {"old_version": F.lit(None).cast("string"), "old_tokens": F.lit(None).cast("long")}

    def as_of(rows: DataFrame, version: str, op: str, old: dict) -> DataFrame:
        now = rows.withColumns({"tokenizer_version": F.lit(version), "tokens": F.col(f"`{version}`"), "op": F.lit(op), **old})
        return now.select("op", "source", "lang", "tokenizer_version", "tokens", "old_version", "old_tokens")

    changes = {"load": as_of(counted, versions[0], INSERT, nothing)}
    for before, version in zip(versions, versions[1:]):
        old = {"old_version": F.lit(before), "old_tokens": F.col(f"`{before}`")}
        changes[f"recount-{version}"] = as_of(counted, version, REVISE, old)
    changes["dedupe"] = as_of(copies_of(counted), versions[-1], DELETE, nothing)
    return changes
