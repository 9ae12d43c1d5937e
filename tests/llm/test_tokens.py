from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketwise.llm import packing, simple8b
from basketwise.llm.tokens import encoder
from tests.conftest import DATA
from tests.llm.helpers import awkward, documents

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
TEXTS = [
    "", "a", "  a b", "a  ", "a \n b", "\n\nx", " lead", "trail ", "<|endoftext|> x", "don't it's I'LL", "abc'sdef",
    "É'S à! ß.", "a\tb c", "x\x1cy", "ª º µm", "12ab ab12", "İstanbul ΣΑΣ", "éa", "a\rb", "日本 語", "foo\n", " \n",
    "!!! ...a", "x  y", "x  y", "x \ny", None, "a\nb c\nd", "\n", "\ta", "Straße neu", "a.\nB",
]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(spark, name):
    own = encoder(public_tokenizers.path(name))
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()]
    for text, ids in zip(texts, own.encode(pa.array(texts))):
        assert ids.tolist() == own.whole(text or ""), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAé ßİ\n\t'.!,0 ́日", max_size=30), max_size=8))
def test_ids_of_any_text(texts):
    for name in FILES:
        own = encoder(public_tokenizers.path(name))
        for text, ids in zip(texts, own.encode(pa.array(texts, pa.string()))):
            assert ids.tolist() == own.whole(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 63).flatmap(lambda b: st.integers(0, (1 << (b + 1)) - 1)), max_size=700))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, blocks = simple8b.encode(ids)
    assert simple8b.decode(words, blocks, len(ids)).tolist() == values
    assert blocks[-1] == len(words)


def test_simple8b_words_around_an_escape():
    """A word of two ids, an escaped one, and a new block with a word of its own."""
    ids = np.array([2**29, 1, 2**62, *[0] * 253, 5], np.uint64)
    words, blocks = simple8b.encode(ids)
    assert words[:3].tolist() == [(14 << 60) | 2**29 | (1 << 30), 0, 2**62]
    assert blocks[1] == len(words) - 1 and int(words[-1]) & (2**60 - 1) == 5
    assert simple8b.decode(words, blocks, len(ids)).tolist() == ids.tolist()


def test_simple8b_packs_and_decodes_one_block():
    ids = np.array([1] * 600 + [49_000] * 300, np.uint64)
    words, blocks = simple8b.encode(ids)
    assert len(words) < 125  # 60 ids of one bit or 3 of 16 bits in a word
    part = words[blocks[1] : blocks[2]]
    assert simple8b.decode(part, np.array([0, len(part)]), 256).tolist() == ids[256:512].tolist()


def expected_ids(rows, name):
    tokenizer = encoder(public_tokenizers.path(name))
    return {i: [*tokenizer.whole(t or ""), 1] for i, t in rows}


def test_files_keep_order_and_ids(spark, tmp_path):
    pick = random.Random(4)
    rows = [(k * 3, " ".join(pick.choice(TEXTS[1:10]) for _ in range(k % 40))) for k in range(150)]
    pick.shuffle(rows)
    rows += [(1, None), (2, "")]
    path = str(tmp_path / "ids")
    simple8b.write_tokens(documents(spark, rows, extra=True), path, public_tokenizers.path(FILES[0]), parts=5)
    read = simple8b.read_tokens(spark, path).orderBy("start").collect()
    want, start = expected_ids(rows, FILES[0]), 0
    assert [r.doc_id for r in read] == sorted(want)
    for r in read:
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == (start, want[r.doc_id])
        start += len(want[r.doc_id])


def test_files_of_awkward_and_empty_tables(spark, tmp_path):
    simple8b.write_tokens(awkward(spark), str(tmp_path / "a"), public_tokenizers.path(FILES[0]), parts=3)
    read = simple8b.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in read] == [None, 1, 2, 2, *range(3, 12)]
    assert read[-1].start == sum(r.n_tokens for r in read[:-1])
    simple8b.write_tokens(documents(spark, []), str(tmp_path / "b"), public_tokenizers.path(FILES[0]), parts=3)
    assert simple8b.read_tokens(spark, str(tmp_path / "b")).collect() == []


def check_pieces(rows, pieces, sizes):
    by_doc = {}
    sequences = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for i, ids in sizes.items():
        own = sorted(by_doc[i], key=lambda p: p.start)
        joined = [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert joined == ids and all(p.doc_tokens == len(ids) for p in own)
    padded = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= p.tier and (at == p.tier or p.tier == packing.TIERS[-1])
        padded += p.tier - at
    groups = {}
    for own in sequences.values():
        groups[own[0].step_group] = groups.get(own[0].step_group, 0) + own[0].tier
    assert max(groups.values()) <= packing.GROUP_TOKENS
    return padded, len(sequences)


def test_packing_places_every_id_once(spark):
    pick = random.Random(8)
    rows = [(k, " ".join(f"w{pick.randrange(99)}" for _ in range(pick.choice([0, 3, 80, 300, 900, 2500])))) for k in range(120)]
    rows += [(500, None), (501, "")]
    pieces = packing.pack(documents(spark, rows, extra=True).repartition(3), public_tokenizers.path(FILES[1])).collect()
    padded, sequences = check_pieces(rows, pieces, expected_ids(rows, FILES[1]))
    assert padded <= 3 * packing.TIERS[-1] and sequences > 50
    assert {p.tier for p in pieces} <= set(packing.TIERS)


def test_packing_of_awkward_and_empty_tables(spark):
    pieces = packing.pack(awkward(spark, extra=True), public_tokenizers.path(FILES[1])).collect()
    assert {p.doc_id for p in pieces} == {None, *range(1, 12)}
    assert len({p.sequence_id for p in pieces}) > 10
    assert packing.pack(documents(spark, []), public_tokenizers.path(FILES[1])).collect() == []


def test_short_tiers_are_used_and_full():
    packer = packing.Packer(0)
    for k, size in enumerate([100, 100, 30, 20, 10, 250, 200, 60]):
        packer.add((k, np.zeros(size, "<u4")))
    packer.pack(last=True)
    lengths = {}
    for row in packer.ready:
        lengths.setdefault((row[4], row[6]), []).append(row[2])
    assert sum(map(sum, lengths.values())) == 770
    assert all(sum(v) == tier or tier == 2048 for (_, tier), v in lengths.items())
    assert {tier for _, tier in lengths} == {256, 2048}


def test_crc_of_ids_is_of_little_endian_words(spark):
    from basketwise.llm.queries import REGISTERED

    row = REGISTERED["op2_simple8b"](spark, DATA).orderBy("doc_id").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    ids = [*encoder(public_tokenizers.path(FILES[0])).whole(text), 1]
    assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
