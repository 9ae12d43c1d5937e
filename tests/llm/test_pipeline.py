"""The pipeline on awkward and on empty tables."""

from __future__ import annotations

import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from basketwise.session import STAGED
from tests.llm.helpers import BASE, DOCS, EXTRA, awkward, documents

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def folder_of(tmp_path, docs, labels, items):
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", items)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_awkward_documents(spark, tmp_path):
    other = " ".join(f"anders{k}" for k in range(90))
    more = documents(spark, [(20, other), (21, other + " " + "neu " * 3), (22, " ".join(f"frage{k}" for k in range(60)))], extra=True)
    docs = awkward(spark, extra=True).unionByName(more)
    items = spark.createDataFrame([(1, " ".join(f"frage{k}" for k in range(20, 40))), (2, None), (3, ""), (None, "kurz")], ITEMS)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], LABELS)
    folder = folder_of(tmp_path, docs, labels, items)
    before = list(STAGED.get(spark, []))
    pieces = corpus_pipeline.run(spark, folder).collect()
    # Of the near copies 1, 2, 2 and 3 the first stays, of 20 and 21 too; 22 holds an item; the others have few words.
    assert {p.doc_id for p in pieces} == {None, 1, 9, 20}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in ((None, BASE), (1, BASE), (20, other))}
    for number, size in sizes.items():
        own = [p for p in pieces if p.doc_id == number]
        assert sum(p.length for p in own) == size and {p.doc_tokens for p in own} == {size}
    # Only what the result reads is left of the stored copies.
    left = [path for path in STAGED[spark] if path not in before]
    assert len(left) == 1 and os.path.isdir(left[0].removeprefix("file:"))


@pytest.mark.parametrize("with_labels", [True, False])
def test_empty_tables(spark, tmp_path, with_labels):
    nothing = spark.createDataFrame([], f"{DOCS}, {EXTRA}")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)] if with_labels else [], LABELS)
    folder = folder_of(tmp_path, nothing, labels, spark.createDataFrame([], ITEMS))
    assert corpus_pipeline.run(spark, folder).collect() == []
