"""Quality rules: an isolation forest on rule statistics.

Two plain rules come first: too few words, or too many words in repeated three-word
windows. Of the other documents the forest decides. Each of its trees splits a few rows of
rule statistics, drawn from all labelled ones, at random until single rows are left; rows that
few splits set apart are anomalous. On all labelled rows the odds of the statistics are set by
how well each alone tells bad rows, and the threshold on the score is calibrated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.labelled import MOST_LABELLED, known_labels
from basketwise.llm.text import SPACE, byte_slices, in_batches, runs, text_or_empty, word_bounds, word_hashes
from basketwise.operators.ranking import exact_quantiles, running_totals, value_totals
from basketwise.session import BROADCAST_ROWS, ensure_checkpoint_dir, stage, staging

FEWEST_WORDS = 50
MOST_REPEATED = 50  # hundredths of the words
WINDOW = 3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# The first of a UTF-8 code point's bytes.
LEADS = (np.arange(256) & 0xC0) != 0x80

TREES = 200
# Small samples, so that many alike bad rows do not hide each other.
TREE_ROWS = 64
SEED = 11
# A rejected clean row counts as much as so many kept bad ones.
CLEAN_WEIGHT = 3.0
LEAST_ODDS = 0.01
# Quantiles that a statistic's scale is cut at.
SCALE_STEPS = 257

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"


def _repeated(hashes: np.ndarray) -> int:
    """Words in windows that occur twice or more."""
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    if len(counts) == len(hashes):
        return 0
    places = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(hashes) + WINDOW - 1, bool)
    for k in range(WINDOW):
        covered[places + k] = True
    return int(covered.sum())


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of the five counts for each text; a null text has none of anything."""
    found = []
    for _, _, data, offsets in byte_slices(texts):
        starts, ends, words = word_bounds(data, offsets)
        windows, before = runs(word_hashes(data, starts, ends), words, WINDOW)
        rows = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
        rows[:, 0] = np.diff(words)
        for place, wanted in ((1, LEADS[data] & ~SPACE[data]), (2, SYMBOLS[data])):
            totals = np.concatenate(([0], np.cumsum(wanted)))
            rows[:, place] = totals[offsets[1:]] - totals[offsets[:-1]]
        for k in range(len(rows)):
            lines = [line for line in data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n") if line.strip()]
            rows[k, 3] = len(lines) - len(set(lines))
            rows[k, 4] = _repeated(windows[before[k] : before[k + 1]])
        found.append(rows)
    return np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < FEWEST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def features(counts: np.ndarray) -> np.ndarray:
    """Shares that do not depend on the length of a text."""
    words, chars, symbols, lines, repeated = counts.T.astype(float)
    words, chars = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([symbols / chars, symbols / words, lines / words, repeated / words, chars / words], 1)


def scale_of(values: np.ndarray) -> list[np.ndarray]:
    """Quantiles of each statistic."""
    return [np.quantile(column, np.linspace(0, 1, SCALE_STEPS)) for column in values.T]


def scaled(values: np.ndarray, scale: list[np.ndarray]) -> np.ndarray:
    """The share of sample rows below each value, so that a rare but plain value is no farther off than the next."""
    places = [np.searchsorted(q, x, "left") + np.searchsorted(q, x, "right") for x, q in zip(values.T, scale)]
    return np.stack(places, 1) / (2 * SCALE_STEPS)


def _mean_path(rows):
    """Splits that an unsuccessful search in a random tree of so many rows takes on average."""
    rows = np.maximum(np.asarray(rows, float), 1)
    return np.where(rows > 2, 2 * (np.log(np.maximum(rows - 1, 1)) + np.euler_gamma) - 2 * (rows - 1) / rows, rows - 1)


@dataclass
class Forest:
    """Trees in flat arrays: a node's feature (-1: leaf), cut, left child (the right one follows) and path length."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    usual: float

    def score(self, values: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 to the power of minus the mean path over the usual one."""
        total = np.zeros(len(values))
        rows = np.arange(len(values))
        for root in self.roots:
            node = np.full(len(values), root)
            while True:
                split = self.feature[node]
                inner = split >= 0
                if not inner.any():
                    break
                right = values[rows, np.maximum(split, 0)] >= self.cut[node]
                node = np.where(inner, self.child[node] + right, node)
            total += self.path[node]
        return 2.0 ** (-total / max(len(self.roots), 1) / self.usual)


def usefulness(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """How well each statistic alone ranks bad rows before or after clean ones, squared; never zero."""
    if not bad.any() or bad.all():
        return np.ones(values.shape[1])
    found = []
    for column in values.T:
        clean = np.sort(column[~bad])
        below = np.searchsorted(clean, column[bad], "left") + np.searchsorted(clean, column[bad], "right")
        found.append(abs(below.mean() / len(clean) - 1))
    return np.array(found) ** 2 + LEAST_ODDS


def fit_forest(
    values: np.ndarray, weights: np.ndarray | None = None, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED, dealt: bool = False
) -> Forest:
    """An isolation forest; every tree has its own sample of `tree_rows` rows.

    With `dealt` the values are these samples, one after the other. A split takes a statistic at random, with the odds of `weights`.
    """
    weights = np.ones(values.shape[1]) if weights is None else weights
    random = np.random.default_rng(seed)
    size = min(tree_rows, len(values))
    deepest = int(np.ceil(np.log2(max(size, 2)))) + 2
    nodes: list[list] = []  # feature, cut, child, path
    roots = []
    for tree in range(trees):
        roots.append(len(nodes))
        nodes.append([-1, 0.0, 0, 0.0])
        drawn = np.arange(tree * size, (tree + 1) * size) if dealt else random.choice(len(values), size, replace=False)
        open_nodes = [(roots[-1], values[drawn], 0)]
        while open_nodes:
            place, rows, depth = open_nodes.pop()
            low, high = rows.min(0), rows.max(0)
            able = np.flatnonzero(high > low)
            if len(rows) <= 1 or depth >= deepest or not len(able):
                nodes[place][3] = depth + float(_mean_path(len(rows)))
                continue
            split = int(random.choice(able, p=weights[able] / weights[able].sum()))
            cut = random.uniform(low[split], high[split])
            right = rows[:, split] >= cut
            if right.all() or not right.any():  # a cut on the edge
                cut = high[split]
                right = rows[:, split] >= cut
            child = len(nodes)
            nodes[place][:3] = [split, cut, child]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            open_nodes += [(child, rows[~right], depth + 1), (child + 1, rows[right], depth + 1)]
    feature, cut, child, path = (np.array(column) for column in zip(*nodes))
    return Forest(feature.astype(int), cut.astype(float), child.astype(int), path, np.array(roots), float(_mean_path(size)) or 1.0)


def calibrate(scores: np.ndarray, bad: np.ndarray) -> float:
    """The threshold that gives the best share of bad rows above it less CLEAN_WEIGHT times that of clean rows."""
    if not bad.any() or bad.all():
        return np.inf
    order = np.argsort(-scores, kind="stable")
    ranked, truth = scores[order], bad[order]
    gain = np.cumsum(truth) / truth.sum() - CLEAN_WEIGHT * np.cumsum(~truth) / (~truth).sum()
    gain[:-1][ranked[:-1] == ranked[1:]] = -np.inf  # equal scores fall on one side
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return np.inf
    following = ranked[best + 1] if best + 1 < len(ranked) else 0.0
    return float((ranked[best] + following) / 2)


@dataclass
class QualityModel:
    forest: Forest | None
    threshold: float
    scale: list[np.ndarray] | None = None

    def verdict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, anomaly, kept)."""
        failed = base_failed(counts)
        anomaly = self.forest.score(scaled(features(counts), self.scale)) if self.forest and len(counts) else np.zeros(len(counts))
        return failed, anomaly, ~failed & (anomaly <= self.threshold)


def _counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(labelled_id, label, counts) of all labelled documents, stored; equal rows once."""
    known = stage(known_labels(labels, "quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("labelled_id"), text_or_empty().alias("text")).where("labelled_id is not null")
    few = known.count() <= BROADCAST_ROWS
    if few:
        texts = texts.join(F.broadcast(known), "labelled_id", "left_semi")

    def count(batches):
        for batch in batches:
            counts = statistics(batch.column("text"))
            yield pa.record_batch([batch.column("labelled_id"), *[pa.array(c) for c in counts.T]], names=["labelled_id", *COUNTS])

    # Numbers are joined and shuffled, not texts.
    numbers = texts.transform(in_batches).mapInArrow(count, "labelled_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    joined = numbers.join(F.broadcast(known) if few else known, "labelled_id")
    return stage(joined.select("labelled_id", "label", *COUNTS).distinct())


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> QualityModel:
    """Forest and threshold from all labelled documents that pass the plain rules.

    Up to `most` labelled documents send six numbers each to the driver; of more it gets
    quantiles, counts by place on the scale, the trees' rows and the threshold. Without such
    documents nothing is anomalous.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    with staging(docs.sparkSession):
        counted = _counted(docs, labels)
        return _fit_whole(counted.toPandas()) if counted.count() <= most else _fit_on_spark(counted)


def _fit_whole(found: pd.DataFrame) -> QualityModel:
    found = found.sort_values(list(found.columns))
    counts = found[COUNTS].to_numpy(np.int64).reshape(-1, len(COUNTS))
    passed = ~base_failed(counts)
    values, bad = features(counts[passed]), found["label"].to_numpy()[passed] == 0
    if len(values) < 2:
        return QualityModel(None, np.inf)
    scale = scale_of(values)
    ranks = scaled(values, scale)
    forest = fit_forest(ranks, usefulness(values, bad))
    return QualityModel(forest, calibrate(forest.score(ranks), bad), scale)


def _fit_on_spark(counted: DataFrame) -> QualityModel:
    """As `_fit_whole`, with quantiles, odds and threshold from jobs over all rows."""
    names = [f"feature{i}" for i in range(features(np.zeros((1, len(COUNTS)), np.int64)).shape[1])]

    def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)

    def judged(batch: pa.RecordBatch, kept: np.ndarray, added: dict[str, np.ndarray]) -> pa.RecordBatch:
        held = [batch.column(c).filter(pa.array(kept)) for c in ("labelled_id", "bad")]
        return pa.record_batch([*held, *[pa.array(x) for x in added.values()]], names=["labelled_id", "bad", *added])

    def share(batches):
        for batch in batches:
            counts = matrix(batch, COUNTS)
            passed = ~base_failed(counts)
            yield judged(batch, passed, dict(zip(names, features(counts[passed]).T)))

    marked = counted.withColumn("bad", (F.col("label") == 0).cast("long"))
    schema = "labelled_id long, bad long, " + ", ".join(f"{c} double" for c in names)
    values = stage(marked.mapInArrow(share, schema))
    rows, bad = values.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if rows < 2:
        return QualityModel(None, np.inf)
    mixed = 0 < bad < rows
    steps = np.linspace(0, 1, SCALE_STEPS).tolist()
    scale = [np.array(exact_quantiles(values, c, steps)["q"], float) for c in names]

    def place(batches):
        for batch in batches:
            yield judged(batch, np.ones(len(batch), bool), dict(zip(names, scaled(matrix(batch, names), scale).T)))

    ranks = stage(values.mapInArrow(place, schema))
    weights = np.array([_usefulness_on_spark(values, c) for c in names]) if mixed else None
    # As many rows as the trees take, whatever the number of all.
    wanted = min(TREES * TREE_ROWS, rows)
    drawn = ranks.orderBy(F.xxhash64("labelled_id", *names), "labelled_id", *names).limit(wanted).toPandas()[names].to_numpy(float)
    forest = fit_forest(drawn, weights, dealt=wanted == TREES * TREE_ROWS)
    if not mixed:
        return QualityModel(forest, np.inf, scale)

    def score(batches):
        for batch in batches:
            yield judged(batch, np.ones(len(batch), bool), {"score": forest.score(matrix(batch, names))})

    scores = ranks.mapInArrow(score, "labelled_id long, bad long, score double")
    return QualityModel(forest, _threshold_on_spark(scores, bad, rows - bad), scale)


def _sides() -> dict:
    return {"bad": F.col("bad"), "clean": F.lit(1).cast("bigint") - F.col("bad")}


def _usefulness_on_spark(values: DataFrame, name: str) -> float:
    """As `usefulness`, of one statistic of a frame with bad and clean rows."""
    ranked = running_totals(stage(value_totals(values, name, _sides())), ["bad", "clean"])
    below = F.col("bad").cast("double") * (2 * F.col("before_clean") + F.col("clean")).cast("double")
    area = ranked.agg(F.sum(below) / F.sum("bad").cast("double") / F.sum("clean").cast("double")).first()[0]
    return (area - 1) ** 2 + LEAST_ODDS


def _threshold_on_spark(scores: DataFrame, bad: int, clean: int) -> float:
    """As `calibrate`, of a frame with bad and clean rows."""
    counts = stage(value_totals(scores, "score", _sides()))
    gain = (F.lit(bad) - F.col("before_bad")) / F.lit(float(bad)) - F.lit(CLEAN_WEIGHT) * (F.lit(clean) - F.col("before_clean")) / F.lit(float(clean))
    best = running_totals(counts, ["bad", "clean"]).select("value", gain.alias("gain")).orderBy(F.desc("gain"), F.desc("value")).first()
    if best["gain"] <= 0:
        return np.inf
    following = counts.where(F.col("value") < best["value"]).agg(F.max("value")).first()[0]
    return float((best["value"] + (following or 0.0)) / 2)


def with_verdict(docs: DataFrame, model: QualityModel, name: str = "verdict") -> DataFrame:
    """`docs` with a struct column of the counts, base_failed, anomaly and kept of its text.

    All columns and rows of `docs` stay; a null text counts as an empty one and fails
    the plain rules. The counts are of the whole text. A column of the name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(VERDICT)
    def judge(texts: pa.Array) -> pa.Array:
        counts = statistics(texts)
        columns = [*counts.T, *shared.value.verdict(counts)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], [*COUNTS, "base_failed", "anomaly", "kept"])

    return in_batches(docs).withColumn(name, judge(text_or_empty()))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns."""
    name = "_".join(["verdict", *docs.columns])
    return with_verdict(docs, fit(docs, labels), name).where(F.col(f"`{name}`.kept")).select(*[docs[c] for c in docs.columns])
