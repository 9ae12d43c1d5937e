from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketwise.llm import chat, licenses, sharding, token_rollup
from basketwise.llm.queries import ORACLES, PROBE
from tests.llm.helpers import awkward, documents

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# --- sharding ------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        room = [(r, k) for k, r in enumerate(bins) if r >= size]
        if room:
            bins[min(room)[1]] -= size
        else:
            bins.append(max(capacity, size) - size)
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(20, 90))
def test_packing_by_classes_equals_packing_one_by_one(sizes, capacity):
    classes = [(s, sizes.count(s)) for s in set(sizes)]
    placed, used = sharding.best_fit_decreasing(classes, capacity)
    load = [0] * used
    for size, name, count in placed:
        load[name] += size * count
    assert sum(load) == sum(sizes)
    want = plain_best_fit(sizes, capacity)
    assert used == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), unique=True, max_size=40), st.lists(st.integers(0, 50), max_size=40))
def test_tree_takes_the_tightest_bin(bins, sizes):
    tree, held = sharding.BinTree(), sorted(bins)
    for room, name in bins:
        tree.add(room, name)
    for size in sizes:
        want = next((b for b in held if b[0] >= size), None)
        assert tree.take(size) == want
        if want:
            held.remove(want)


def check_shards(rows, docs, shards):
    by_key, slots, load = {}, {}, [0] * shards
    for r in rows:
        by_key.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(len(v) == 1 for v in by_key.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    return load


def test_shards_have_near_equal_bytes(spark):
    pick = random.Random(6)
    texts = ["ä" * pick.randrange(1, 900) + str(k) for k in range(400)]
    docs = [(k, pick.choice(texts)) for k in range(900)] + [(2000, None), (2001, ""), (None, "x"), (5, "x")]
    rows = sharding.shard(documents(spark, docs, extra=True)).collect()
    load = check_shards(rows, docs, 8)
    assert max(load) - min(load) <= 0.01 * sum(load)


def test_a_group_larger_than_a_share_has_a_shard_of_its_own(spark):
    docs = [(k, "gleich" * 50) for k in range(100)] + [(1000 + k, f"{k}" * 40) for k in range(150)]
    load = check_shards(sharding.shard(documents(spark, docs)).collect(), docs, 8)
    rest = sorted(load)[:-1]
    assert max(load) == 30_100 and max(rest) - min(rest) <= 500


def test_fixed_capacity_packs_exact_sizes(spark):
    docs = [(1, "a" * 5_000), (2, "b" * 4_998)]
    assert {r.shard for r in sharding.shard(documents(spark, docs), capacity=10_000).collect()} == {0}
    pick = random.Random(9)
    for capacity in (5_000, 9_973):
        docs = [(k, f"{k}" * pick.randrange(1, 900)) for k in range(150)] + [(1000, "5"), (1001, "5")]
        groups = {}
        for _, text in docs:
            groups[text] = groups.get(text, 0) + len(text) + 1
        rows = sharding.shard(documents(spark, docs), capacity=capacity).collect()
        load = {}
        for r in rows:
            load[r.shard] = load.get(r.shard, 0) + r.size
        assert sorted(load) == list(range(len(load))) and max(load.values()) <= capacity
        assert sorted(capacity - used for used in load.values()) == plain_best_fit(groups.values(), capacity)


def test_fixed_capacity_and_awkward_rows(spark):
    rows = sharding.shard(awkward(spark, extra=True), capacity=2_000).collect()
    assert len(rows) == 13 and max(r.shard for r in rows) >= 2
    assert sharding.shard(documents(spark, [])).collect() == []


# --- rollups -------------------------------------------------------------------------

CHANGES = "op string, source string, lang string, tokenizer_version string, tokens long, old_version string, old_tokens long"


def test_signed_batches_and_repeated_commits(spark, tmp_path):
    store = token_rollup.RollupStore(spark, str(tmp_path / "store"))
    first = [("insert", "a", "en", "v1", 10, None, None)] * 3 + [("insert", None, "en", "v1", 5, None, None)]
    second = [
        ("revise", "a", "en", "v2", 8, "v1", 10),
        ("revise", "a", "en", "v1", 11, None, 10),
        ("delete", "a", "en", "v1", 10, None, None),
        ("delete", None, "en", "v1", None, None, None),
    ]
    assert store.totals().collect() == []
    for _ in range(2):
        store.commit("one", spark.createDataFrame(first, CHANGES))
        store.commit("two", spark.createDataFrame(second, CHANGES))
    assert store.commit("two", spark.createDataFrame(first, CHANGES)) is False
    assert store.committed() == ["one", "two"]
    assert sorted((tuple(r) for r in store.totals().collect()), key=str) == sorted(
        [("a", "en", "v1", 1, 11), ("a", "en", "v2", 1, 8), (None, "en", "v1", 0, 5)], key=str
    )


def test_a_write_that_died_is_replaced(spark, tmp_path):
    store = token_rollup.RollupStore(spark, str(tmp_path / "store"))
    broken = tmp_path / "store" / "batches" / "one" / "dead" / "deltas"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert store.committed() == []
    assert store.commit("one", spark.createDataFrame([("insert", "a", "en", "v1", 4, None, None)], CHANGES))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 1, 4)]


def test_compaction_keeps_totals_and_names(spark, tmp_path):
    store = token_rollup.RollupStore(spark, str(tmp_path / "store"))
    batch = [spark.createDataFrame([("insert", f"s{k % 2}", "en", "v1", k, None, None)], CHANGES) for k in range(4)]
    assert store.compact() == 0
    store.commit("b0", batch[0])
    store.commit("b1", batch[1])
    assert store.compact() == 2 and store.compact() == 0
    store.commit("b2", batch[2])
    assert store.commit("b0", batch[3]) is False and store.commit("b2", batch[3]) is False
    assert store.committed() == ["b0", "b1", "b2"]
    assert sorted(tuple(r) for r in store.totals().collect()) == [("s0", "en", "v1", 2, 2), ("s1", "en", "v1", 1, 1)]
    store.commit("b3", batch[3])
    assert store.compact() == 2 and store.commit("b1", batch[1]) is False
    assert sorted(tuple(r) for r in store.totals().collect()) == [("s0", "en", "v1", 2, 2), ("s1", "en", "v1", 2, 4)]
    assert [p.name for p in (tmp_path / "store" / "batches").iterdir()] == []


def test_of_two_writers_of_one_batch_one_counts(spark, tmp_path):
    store = token_rollup.RollupStore(spark, str(tmp_path / "store"))
    changes = spark.createDataFrame([("insert", "a", "en", "v1", 4, None, None)], CHANGES)
    real, done = token_rollup.signed_deltas, []

    def slow(frame):
        # Meanwhile another writer commits the same name.
        token_rollup.signed_deltas = real
        done.append(token_rollup.RollupStore(spark, store.path).commit("one", changes))
        return real(frame)

    token_rollup.signed_deltas = slow
    try:
        done.append(store.commit("one", changes))
    finally:
        token_rollup.signed_deltas = real
    assert done == [True, False]
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 1, 4)]


def test_unknown_changes_are_refused(spark, tmp_path):
    store = token_rollup.RollupStore(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="unknown change"):
        store.commit("one", spark.createDataFrame([("upsert", "a", "en", "v1", 4, None, None)], CHANGES))
    with pytest.raises(ValueError):
        store.commit("a/b", spark.createDataFrame([], CHANGES))
    assert store.committed() == []


VERSIONS = {name: public_tokenizers.path(f"{name}.json") for name in ("word_bpe_49k", "byte_bpe_50k")}


def test_documents_as_changes(spark, tmp_path):
    """Each batch leaves the counts of the library, and the last one row of each text."""
    library = {name: Tokenizer.from_file(path) for name, path in VERSIONS.items()}
    docs = awkward(spark, extra=True)
    texts = [r.text or "" for r in docs.collect()]
    sizes = {name: [len(t.encode(text, add_special_tokens=False).ids) for text in texts] for name, t in library.items()}
    store = token_rollup.RollupStore(spark, str(tmp_path / "store"))
    found = []
    for name, changes in token_rollup.document_changes(docs, VERSIONS).items():
        store.commit(name, changes)
        found.append([(r.tokenizer_version, r.documents, r.tokens) for r in store.totals().collect()])
    single = {text: size for text, size in zip(texts, sizes["byte_bpe_50k"])}
    assert found == [
        [("word_bpe_49k", 13, sum(sizes["word_bpe_49k"]))],
        [("byte_bpe_50k", 13, sum(sizes["byte_bpe_50k"]))],
        # Rows that repeat a text go, with the same number or none too.
        [("byte_bpe_50k", len(single), sum(single.values()))],
    ]
    empty = token_rollup.RollupStore(spark, str(tmp_path / "empty"))
    for name, changes in token_rollup.document_changes(documents(spark, []), VERSIONS).items():
        empty.commit(name, changes)
    assert empty.totals().collect() == [] and empty.committed() == ["dedupe", "load", "recount-byte_bpe_50k"]


def test_the_row_of_the_smallest_number_stays(spark):
    rows = [(None, "a"), (5, "a"), (3, "a"), (3, "a"), (9, None), (8, ""), (7, "b")]
    counted = token_rollup.counted_documents(documents(spark, rows).repartition(3), VERSIONS)
    gone = sorted((str(r.doc_id) for r in token_rollup.copies_of(counted).collect()))
    assert gone == ["3", "5", "9", "None"]


# --- licences ------------------------------------------------------------------------

MIT = (
    "The MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and "
    "associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation "
    "the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit "
    "persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and "
    "this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
)


def test_license_rules(spark):
    texts = [
        "Erste Zeile\nReleased under the MIT License.\nweiter",
        "Licensed under the Apache License, Version 2.0. LICENSED UNDER CC BY-NC 4.0!",
        MIT,
        "Permission denied. The MIT Licence",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ]
    docs = [*enumerate(texts), (None, None), (7, ""), (7, "")]
    rows = sorted(licenses.scan(documents(spark, docs, extra=True)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.licenses for r in rows] == ["MIT", "Apache-2.0,CC-BY-NC-4.0", "MIT", "", "GPL-3.0-or-later", "", "", ""]
    assert [r.n_sentences for r in rows] == [1, 2, 3, 0, 3, 0, 0, 0]
    assert rows[5].sentence_ids == ","


def test_sql_of_the_scan_has_all_sentences_and_rules(spark):
    """The operator and its SQL on texts made of known sentences and tags in any order."""
    pick = random.Random(4)
    known = [s.replace("*", "some name") for s in licenses.DEFAULT_SENTENCES.values()]
    tags = ["SPDX-License-Identifier: MIT", "// spdx-license-identifier: (mit OR GPL-2.0+) AND Foo-1.0", "SPDX-License-Identifier: GPL-3.0 WITH x"]
    texts = [". ".join(pick.choice(known) for _ in range(pick.randrange(1, 6))) + "." for _ in range(150)]
    texts += ["\n".join(pick.choice([*known, *tags, "x", ""]) for _ in range(pick.randrange(1, 7))) for _ in range(150)]
    texts += [s.replace(" ", "\n", 3) for s in known] + [None, "", "\n", MIT]
    frame = documents(spark, enumerate(texts))
    found = sorted(tuple(r) for r in licenses.scan(frame).collect())
    connection = duckdb.connect()
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    connection.register("documents", table)
    assert sorted(connection.execute(ORACLES["op7_license_scan"]).fetchall()) == found
    assert len({licence for *_, names in found for licence in names.split(",")}) > 20


def test_licenses_of_both_readings_of_a_text_count(spark):
    header = "Title\nLicensed under CC BY 4.0."
    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in\ncompliance with the License.'
    )
    texts = [
        MIT + "\n" + header,
        header + "\n\n" + MIT,
        apache + "\n\n" + header,
        # More sentences by lines than by paragraphs.
        "Head\nReleased under the MIT License\nLicensed under CC BY 4.0\nMIT License\n\nThis work is licensed under "
        "the GNU\nGeneral Public License version 3.",
        # A line that is a sentence of its own, with signs around it, counts once, twice if it is there twice.
        "---\nLicensed under CC BY 4.0\n---",
        "Licensed under CC BY 4.0\nLicensed under CC BY 4.0",
        # The whole is known, and so is one of its lines.
        "Released under\nthe MIT license",
    ]
    rows = sorted(licenses.scan(documents(spark, enumerate(texts))).collect(), key=lambda r: r.doc_id)
    assert [r.licenses for r in rows] == ["CC-BY-4.0,MIT", "CC-BY-4.0,MIT", "Apache-2.0,CC-BY-4.0", "CC-BY-4.0,GPL-3.0-only,MIT", "CC-BY-4.0", "CC-BY-4.0", "MIT"]
    assert [r.n_sentences for r in rows] == [4, 4, 3, 4, 1, 2, 2]


BSD2 = (
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following "
    "conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and "
    "the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of "
    "conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
)
BSD3 = BSD2 + (
    "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products "
    "derived from\n   this software without specific prior written permission.\n\n"
)
GNU = (
    "This program is free software; you can redistribute it and/or modify it\nunder the terms of the GNU{} General Public License as "
    "published by the\nFree Software Foundation; {}version {} of the License{}.\n\n"
)
LATER = ", or (at your\noption) any later version"


def test_licenses_of_the_default_table(spark):
    cases = {
        BSD2: "BSD-2-Clause",
        BSD3: "BSD-3-Clause",
        BSD3.replace("the copyright holder", "Example Inc."): "BSD-3-Clause",
        BSD2 + BSD3: "BSD-2-Clause,BSD-3-Clause",
        BSD3 + BSD2: "BSD-2-Clause,BSD-3-Clause",
        BSD3 + BSD3: "BSD-3-Clause",
        GNU.format("", "", "2", ""): "GPL-2.0-only",
        GNU.format("", "either ", "2", LATER): "GPL-2.0-or-later",
        GNU.format("", "either ", "2", LATER) + GNU.format(" Lesser", "either ", "3", LATER): "GPL-2.0-or-later,LGPL-3.0-or-later",
        GNU.format(" Affero", "either ", "3", LATER).replace("Foundation;", "Foundation,"): "AGPL-3.0-or-later",
        GNU.format(" Affero", "either ", "3", LATER): "AGPL-3.0-or-later",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy": "MPL-2.0",
        "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is "
        "available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
        "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and "
        "redistribute it\nfreely, subject to the following restrictions:\n": "Zlib",
        "Distributed under the Boost Software License, Version 1.0.\n(See file": "BSL-1.0",
        "/* SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) OR mit */\nint x;": "GPL-2.0-or-later,MIT",
        "# spdx-license-identifier: PostgreSQL -- see the file": "PostgreSQL",
        "SPDX-License-Identifier: BSD-3-Clause\n\n" + BSD2: "BSD-2-Clause,BSD-3-Clause",
    }
    rows = sorted(licenses.scan(documents(spark, enumerate(cases))).collect(), key=lambda r: r.doc_id)
    assert [r.licenses for r in rows] == list(cases.values())


def test_the_whole_apache_header_is_one_rule(spark):
    header = (
        'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the '
        "License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by "
        "applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n"
    )
    (whole,) = [names for _, names in licenses.DEFAULT_RULES if "apache-url" in names]
    (row,) = licenses.scan(documents(spark, [(1, header)]), rules=[("Apache-2.0", whole)]).collect()
    assert (row.licenses, row.n_sentences) == ("Apache-2.0", 5)


def test_license_tables_are_arguments(spark):
    table, rules = {"a": "use it", "b": "but * owe me a beer"}, [("Use", ["a"]), ("Beer", ["a", "b"])]
    texts = ["Use it. But you owe me a beer!", "Use it.", "But owe me a beer. Released under the MIT License.", "Use it. But you owe me a beer. Use it."]
    rows = sorted(licenses.scan(documents(spark, enumerate(texts)), table, rules).collect(), key=lambda r: r.doc_id)
    assert [r.licenses for r in rows] == ["Beer", "Use", "", "Beer,Use"]
    assert licenses.scan(documents(spark, [(1, "Use it.")]), {}, []).first().licenses == ""
    with pytest.raises(ValueError):
        licenses.scan(documents(spark, []), table, [("Use", ["c"])])


def test_license_scan_is_native_and_without_shuffle(spark):
    plan = licenses.scan(awkward(spark, extra=True))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert licenses.scan(documents(spark, [])).collect() == []
    assert licenses.scan(awkward(spark)).where("licenses = 'MIT'").count() == 1


# --- chat ----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a\\\n</turn>", max_size=9), st.text(alphabet="\\</turn>n\nx é", max_size=30)), max_size=5))
def test_template_is_reversible(turns):
    text, _ = chat.formatted_window([((role, body), False) for role, body in turns])
    assert list(chat.read_turns(text)) == turns


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int, mask string")


def expected(rows):
    by_id = {}
    for conv, turn, role, text, *_ in rows:
        by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    found = {}
    for conv, turns in by_id.items():
        turns.sort()
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        found[conv] = (len(turns), digest(whole), len(loss), digest(loss))
    return found


@pytest.mark.parametrize("budget, history", [(1024, 256), (60, 30), (25, 0), (1, 1)])
def test_windows_read_back(spark, budget, history):
    pick = random.Random(budget)
    rows = [(-7, 0, "user", PROBE, 1, "m"), (-7, 1, "assistant", PROBE, 1, "m")]
    for conv in range(12):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * pick.randrange(1, 9)
        for turn, role in enumerate(roles):
            rows.append((conv, turn, role, " ".join(pick.choice(["a", "bc", "</turn>", "\\", "é\n"]) for _ in range(pick.randrange(30))), 1, "m"))
    rows += [(50, None, None, None, 1, "m"), (50, 0, "assistant", "x", 1, "m"), (50, 0, "assistant", "x", 1, "m"), (None, 0, "user", "", 1, "m")]
    rows.append((51, 0, "assistant", "lang " * 5_000, 1, "m"))
    windows = chat.format_windows(conversations(spark, rows), BYTES, budget, history)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert found == expected(rows)
    library = Tokenizer.from_file(BYTES)
    for w in windows.collect():
        fresh = w.n_turns - w.repeated
        assert fresh >= 1 and (w.tokens <= budget or fresh == 1)
        assert w.tokens == len(library.encode(w.text, add_special_tokens=False).ids)
        turns = list(chat.read_turns(w.text))
        assert len(turns) == w.n_turns
        if w.window and w.repeated and w.conv_id in (0, 3, 6, 9):
            assert turns[0][0] == "system"
        for start, end in w.mask:
            assert w.text[start:end].count("<turn>") == w.text[start:end].count("\\<turn>")


def test_no_conversations(spark):
    windows = chat.format_windows(conversations(spark, []), BYTES)
    assert windows.collect() == [] and chat.read_back(windows).collect() == []
