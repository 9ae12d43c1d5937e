from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from basketwise.llm import quality, toxicity
from basketwise.llm.labelled import held_out, labelled_texts
from pyspark.sql import functions as F
from tests.conftest import DATA
from tests.llm.helpers import awkward, documents

LARGER = DATA.replace("0.001", "0.01")


def counts_of(text):
    raw = (text or "").encode()
    words = raw.split()
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {k + j for k, window in enumerate(windows) if often[window] > 1 for j in range(3)}
    lines = [line for line in raw.split(b"\n") if line.split()]
    chars = sum(len(w.decode()) for w in words)
    return [len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_statistics_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n ", "a b c a b c", "a\n\na\n a\na ", "é|ü <x>", "\x0b\x0ca\x85b", "x y z\nx y z\nx"]
    assert quality.statistics(pa.array(texts)).tolist() == [counts_of(t) for t in texts]


def test_quality_of_awkward_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, None), (None, 1)], "doc_id long, quality int")
    docs = awkward(spark, extra=True)
    model = quality.fit(docs, labels)
    rows = quality.with_verdict(docs, model).collect()
    assert len(rows) == 13
    for row in rows:
        assert [row.verdict[c] for c in quality.COUNTS] == counts_of(row.text)
        assert not (row.verdict.base_failed and row.verdict.kept)
        assert row.verdict.base_failed == (row.verdict.n_words < 50 or 100 * row.verdict.n_repeat_words > 50 * row.verdict.n_words)
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and all(r.verdict == "v" for r in kept.collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.kept_documents(documents(spark, []), none).collect() == []
    assert quality.fit(docs, none).threshold == np.inf


def test_forest_sets_outliers_apart_and_is_fixed():
    random_rows = np.random.default_rng(1).normal(size=(2_000, 4))
    random_rows[:100, 2] += 20
    forest = quality.fit_forest(random_rows)
    scores = forest.score(random_rows)
    assert scores[:100].mean() > scores[100:].mean() + 0.1
    assert np.array_equal(scores, quality.fit_forest(random_rows).score(random_rows))
    threshold = quality.calibrate(scores, np.arange(2_000) < 100)
    assert (scores[:100] > threshold).mean() > 0.9 and (scores[100:] > threshold).mean() < 0.05


def test_forest_of_equal_rows_scores_all_alike():
    scores = quality.fit_forest(np.ones((50, 3))).score(np.ones((5, 3)))
    assert len(set(scores.tolist())) == 1


def test_quality_finds_bad_documents_and_keeps_clean_ones(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    judged = quality.with_verdict(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("not verdict.base_failed")
    found = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", F.col("verdict.kept").alias("kept")).count().collect()}
    assert found.get((0, True), 0) <= 0.15 * found[0, False]
    assert found.get((1, False), 0) <= 0.06 * found[1, True]


END, BLANK = chr(toxicity.END), chr(toxicity.BLANK)


def test_quality_of_documents_it_has_not_seen(spark):
    folder = DATA.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    tested = labels.where(held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    judged = quality.with_verdict(docs.join(tested, "doc_id"), model).where("not verdict.base_failed")
    found = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", F.col("verdict.kept").alias("kept")).count().collect()}
    assert found.get((0, True), 0) <= 0.05 * found[0, False] and found[0, False] > 40
    assert found.get((1, False), 0) <= 0.01 * found[1, True] and found[1, True] > 400


def gapped(text):
    """Weights of all subsequences by position; blanks take a place but are no characters."""
    marked, found = chr(toxicity.START) + text, Counter()
    for at in combinations(range(len(marked)), toxicity.ORDER):
        word = "".join(marked[k] for k in at)
        if BLANK not in word:
            found[word] += toxicity.DECAY ** (at[-1] - at[0] + 1)
    return found


@pytest.mark.parametrize(
    "left, right", [("idxiot" + END, "idiot" + END), ("a", "ab"), ("thanble", "the"), ("größe", "gro"), ("abab", "baba"), (f"id{BLANK}iot", "idiot")]
)
def test_kernel_equals_all_subsequences(left, right):
    a, b = gapped(left), gapped(right)
    dot = lambda x, y: sum(v * y[k] for k, v in x.items())
    assert toxicity.kernel([left, "zzz"], [right])[0, 0] == pytest.approx(dot(a, b) / dot(b, b), rel=1e-9)


def windows_by_hand(text, stem):
    """Windows of a stem by trying all ways; the nearest end of every word's start."""
    stream = re.sub(r"[\W_]+", BLANK, text.lower()) + BLANK
    word = stem.removesuffix(END)
    found = []
    for start in [k for k in range(len(stream)) if stream[k] != BLANK and (k == 0 or stream[k - 1] == BLANK)]:
        ends = []

        def walk(at, letter):
            if letter == len(word):
                tail = stream.index(BLANK, at) - at - 1 if stem.endswith(END) else 0
                inserted = len(stream[start : at + 1].replace(BLANK, "")) - len(word) + tail
                if inserted <= toxicity.GAP:
                    ends.append(at)
                return
            for ahead in range(at + 1, min(at + toxicity.GAP + 2, len(stream))):
                if stream[ahead] == word[letter]:
                    walk(ahead, letter + 1)

        if stream[start] == word[0]:
            walk(start, 1)
        if ends:
            found.append(stream[start : stream.index(BLANK, min(ends))] + END)
    return found


@pytest.mark.parametrize("stem", ["idiot" + END, "idiot", "scum" + END, "aba"])
def test_windows_equal_a_search_of_all_ways(stem):
    pick = random.Random(3)
    texts = ["".join(pick.choice("idot scumab -.") for _ in range(300)) for _ in range(20)]
    texts += ["", "idiot", "an id iot, idxxiot! i - d. i o t idxxxiot", "IDIOTS iidiot i d i o t x", "-" * 50, "s_c_u_m scuxm"]
    found, words = toxicity.windows(texts, [stem])
    gap = toxicity.GAP if len(stem.removesuffix(END)) >= toxicity.SHORT else 0
    if gap:
        assert found == [windows_by_hand(t, stem) for t in texts]
    assert words.tolist() == [len(re.sub(r"[\W_]+", " ", t).split()) for t in texts]


def test_spellings_of_an_insult_are_windows_of_it():
    spellings = ["idiot", "idxiot", "idxyiot", "iddiot", "id iot", "id-iot", "i d i o t", "i - d - i - o - t", "i. d. i. o. t.", "*I* *D* ... i / o (t)!"]
    found, _ = toxicity.windows([f"you {s} there" for s in spellings], ["idiot" + END])
    assert all(len(f) == 1 for f in found)
    none, _ = toxicity.windows(["idxxxiot", "you id", "iot id", "xidiot", "idio"], ["idiot" + END])
    assert not any(none)


def test_windows_do_not_depend_on_neighbours_or_slices(monkeypatch):
    pick = random.Random(4)
    texts = ["".join(pick.choice("idot scum.") for _ in range(pick.randrange(200))) for _ in range(60)]
    stems = ["idiot" + END, "scum", "mist"]
    alone = [toxicity.windows([t], stems)[0][0] for t in texts]
    assert toxicity.windows(texts, stems)[0] == alone
    monkeypatch.setattr(toxicity, "SCANNED", 500)
    assert toxicity.windows(texts, stems)[0] == alone


def test_gapped_insults_stay_toxic():
    stems = [(w + END, 60, 0, 300.0) for w in ("idiot", "scum", "worthless", "schwachkopfige")]
    toxic = Counter({s[0]: 40 for s in stems})
    clean = Counter({"ideanot" + END: 5, f"so{BLANK}cum" + END: 3, "idiom" + END: 4})
    model = toxicity.train_machine(stems, toxic, clean)
    assert model.decide([s[0] for s in stems]).min() > 0.5 and model.decide(sorted(clean)).max() < 0
    near = ["idxiot", "idiiot", f"id{BLANK}iot", "scqum", f"sc{BLANK}um", "worthxyless", "schwa7chkopfige", f"schwach{BLANK}kopfige"]
    assert model.decide([w + END for w in near]).min() > 0.3


def test_stems_are_as_long_as_their_texts_allow():
    listed = [("tra", 50, 0, 200.0), ("trash", 50, 0, 200.0), ("trash" + END, 50, 0, 200.0), ("trashy" + END, 3, 0, 25.0)]
    listed += [("fam", 40, 10, 100.0), ("family", 20, 9, 50.0)]
    assert [s[0] for s in toxicity.choose_stems(listed)] == ["trash" + END, "fam", "trashy" + END]
    assert toxicity.stems_of("Abcd, e-f abc") == {"abc", "abcd", "abcd" + END, "abc" + END}


@pytest.fixture(scope="module")
def judged(spark):
    """The model of the larger tables, and their labelled documents that are held out."""
    folder = DATA.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    tested = docs.where(held_out(F.col("doc_id"))).join(labels, "doc_id").where("toxic is not null")
    return toxicity.fit(docs, labels), tested.select("text", "lang", "toxic").orderBy("doc_id").collect()


def test_spoiled_insults_in_clean_texts_are_found(judged):
    model, tested = judged
    clean = [r.text for r in tested if not r.toxic and r.lang == "en"][:60]
    insults = [s.removesuffix(END) for s, *_ in zip(model.stems, range(10))]
    pick = random.Random(1)

    def share(spoil):
        texts = []
        for text in clean:
            words = text.split(" ")
            insult = pick.choice(insults)
            words.insert(pick.randrange(len(words) + 1), spoil(insult, pick.randrange(1, len(insult))))
            texts.append(" ".join(words))
        return (model.score(texts, {}) >= 0.5).mean()

    assert share(lambda w, k: w) == 1
    assert share(lambda w, k: w[:k] + "x" + w[k:]) >= 0.9
    assert share(lambda w, k: w[:k] + "xq" + w[k:]) >= 0.9
    assert share(lambda w, k: w[:k] + w[k - 1] + w[k:]) >= 0.9
    assert share(lambda w, k: w[:k] + " " + w[k:]) >= 0.9
    assert share(lambda w, k: w[:k] + "-" + w[k:]) >= 0.9
    assert share(lambda w, k: " ".join(w)) >= 0.9
    assert share(lambda w, k: "harmless") <= 0.02


def test_clean_documents_that_were_held_out_are_left_alone(judged):
    model, tested = judged
    found = model.score([r.text or "" for r in tested], {}) >= 0.5
    toxic = np.array([r.toxic != 0 for r in tested])
    assert found[toxic].sum() >= 0.9 * toxic.sum()
    assert found[~toxic].sum() <= 2


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").collect()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5)
    tested = [r for r in rows if r.held_out]
    toxic = [r for r in tested if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in tested if not r.toxic) <= 0.08 * len(tested)


def test_only_rows_that_are_not_held_out_are_learned_from(spark):
    docs = documents(spark, [(k, f"text {k}") for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    used = {r.labelled_id for r in labelled_texts(docs, labels, "toxic", 1_000, without_held_out=True).collect()}
    left = {r.doc_id for r in docs.where(held_out(F.col("doc_id"))).collect()}
    assert left and used == set(range(60)) - left
    assert labelled_texts(docs, labels, "toxic", 7).count() == 7


def test_toxicity_of_awkward_and_empty_tables(spark):
    docs = awkward(spark, extra=True)
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    kept = toxicity.harmless_documents(docs, none)
    assert kept.columns == docs.columns and kept.count() == 13
    assert toxicity.scored(documents(spark, []), none).collect() == []


def test_quality_is_fitted_on_all_labelled_rows(spark):
    """Beyond the driver's rows the scale, odds and threshold are those of all rows."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    whole, parted = quality.fit(docs, labels), quality.fit(docs, labels, most=10)
    assert all(np.allclose(a, b) for a, b in zip(whole.scale, parted.scale))
    verdicts = [{r.doc_id: r.verdict.kept for r in quality.with_verdict(docs, m).collect()} for m in (whole, parted)]
    known = labels.where("quality is not null").count()
    assert known > 10 and sum(verdicts[0][k] != verdicts[1][k] for k in verdicts[0]) <= 0.02 * len(verdicts[0])


def test_threshold_and_odds_of_spark_jobs(spark):
    rng = np.random.default_rng(4)
    bad = rng.random(3_000) < 0.2
    scores = np.round(rng.random(3_000) + 0.4 * bad, 2)
    frame = spark.createDataFrame([(float(s), int(b)) for s, b in zip(scores, bad)], "score double, bad long")
    found = quality._threshold_on_spark(frame, int(bad.sum()), int((~bad).sum()))
    assert abs(found - quality.calibrate(scores, bad)) < 1e-12 and np.isfinite(found)
    assert np.allclose(quality._usefulness_on_spark(frame, "score"), quality.usefulness(scores[:, None], bad)[0])
