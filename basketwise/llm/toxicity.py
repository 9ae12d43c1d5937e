"""Toxicity: a support vector machine on a gapped string kernel, with Nyström landmarks.

Labelled texts show which beginnings of words, up to whole words, are typical of toxic
ones; the strongest are the stems. In the sentences of a text, blanks and signs are gaps
between letters, and a window is a piece of it that starts with a word and holds all
letters of a stem in order, with at most GAP other letters between them in all, and any
number of signs. So "idiot",
"idxiot", "idxxiot", "iddiot", "id iot", "id-iot" and "i - d. i o t" are windows of one stem.
A window goes on to the end of its last word.

The kernel of a window with a landmark counts the subsequences of three characters they
share, each weighted down by every character it spans; signs and blanks widen spans and
are no characters themselves. It is divided by the landmark's kernel with itself. Against
the landmarks only (the stems and the most common windows of clean texts), with their own
kernel matrix K, the features of a window are its values times K^(-1/2), and a linear
machine on them is the kernel machine. It is trained on the windows of labelled sentences,
each as often as it occurs, and on spoiled copies of the stems. Whole texts are scanned,
and every distinct window is evaluated once in a Python process.

A text's score is a logistic function of its most toxic windows, of how many toxic ones
there are, and of its length, fitted on labelled texts, and on clean ones with one
spoiled stem that is by itself a sign of a toxic text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.labelled import MOST_LABELLED, held_out, labelled_texts
from basketwise.llm.text import in_batches, text_or_empty

ORDER = 3
DECAY = 0.9
# Letters that may stand between or behind those of a stem, in all; between two there is one run of signs. Stems of fewer letters than SHORT have none.
GAP, SHORT = 2, 4
# Fixed codes: what a stem starts and ends with, a run of blanks and signs, and what lies between texts.
START, END, BLANK, WALL = 2, 3, 1, 0
# A window goes on for so many characters at most after its last letter of a stem.
TAIL = 16
LETTERS = 3, 20
# Characters of text that are scanned at once.
SCANNED = 1 << 20

# Size of the machine, whatever the number of labelled texts.
STEMS = 64
CLEAN_LANDMARKS = 32
# Stems of less evidence (log-likelihood ratio) are not learned.
LEAST_EVIDENCE = 20.0
LISTED = 4_000
# A longer stem that loses no more than this share of the toxic texts replaces the shorter one.
ALIKE = 0.9
# A stem is a sign by itself if one in so many of the texts that have it is clean at most, one more counted.
DOUBT = 0.04
SPOILED = 24
REGULAR = 0.02
TOP = 3
FOLDS = 4
MOST_WINDOWS = 200_000

_letters = np.array([chr(c).isalnum() for c in range(1 << 16)])


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case codes with one BLANK for each run of signs, the starts of all words, and the text of each word."""
    joined = "\x00".join(t.lower().replace("\x00", " ") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    wall = codes == 0
    # A run of signs is kept as its first place; walls are kept and widened beyond any gap.
    first = ~letter & ~wall
    first[1:] &= letter[:-1] | wall[:-1]
    kept = letter | first | wall
    stream = np.where(letter, codes, np.where(wall, WALL, BLANK)).astype(np.uint32)[kept]
    stream = np.repeat(stream, np.where(stream == WALL, GAP + 2, 1))
    border = np.full(GAP + 2, WALL, np.uint32)
    stream = np.concatenate((border, stream, border, np.zeros(TAIL, np.uint32)))
    inside = stream > END
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    number = np.cumsum(stream == WALL) // (GAP + 2) - 1
    return stream, starts, number[starts]


def _found(stream: np.ndarray, letters: np.ndarray, starts: np.ndarray, stem: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and last places of the windows of a stem (its letters, then perhaps END); the nearest end of each start.

    `letters` counts the letters of the stream up to each place.
    """
    at, last = starts, starts
    inside = stem if stem[-1] != END else stem[:-1]
    for code in inside[1:]:
        tries = last[:, None] + np.arange(1, gap + 2)
        hits = stream[tries] == code
        rows, columns = np.nonzero(hits)
        at, last = at[rows], tries[rows, columns]
        # Of several ways to one place one is enough.
        ways = np.unique((at << 7) + (last - at))
        at, last = ways >> 7, (ways >> 7) + (ways & 127)
    ahead = stream[last[:, None] + np.arange(1, gap + 2)] > BLANK
    tail = np.where(ahead.all(axis=1), gap + 1, np.argmin(ahead, axis=1)) if stem[-1] == END else np.zeros(len(last), np.int64)
    inserted = letters[last] - letters[at] + 1 - len(inside) + tail
    at, last = at[inserted <= gap], last[inserted <= gap]
    nearest = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
    return at[nearest], last[nearest]


def windows(texts: list[str], stems: list[str]) -> tuple[list[list[str]], np.ndarray]:
    """Per text the windows of all stems, each place once, and the number of its words."""
    found: list[list[str]] = [[] for _ in texts]
    words = np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        size, end = 0, first
        while end < len(texts) and (end == first or size + len(texts[end]) <= SCANNED):
            size += len(texts[end])
            end += 1
        stream, starts, owner = _stream(texts[first:end])
        words[first:end] = np.bincount(owner, minlength=end - first)
        order = np.argsort(stream[starts], kind="stable")
        initials = stream[starts][order]
        letters = np.cumsum(stream > END)
        spans: dict[int, int] = {}
        for stem in stems:
            codes = _codes(stem)
            low, high = np.searchsorted(initials, [codes[0], codes[0] + 1])
            gap = GAP if len(stem.rstrip(chr(END))) >= SHORT else 0
            for at, last in zip(*(side.tolist() for side in _found(stream, letters, starts[np.sort(order[low:high])], codes, gap))):
                spans[at] = max(spans.get(at, 0), last)
        places = sorted(spans)
        for at, text in zip(places, owner[np.searchsorted(starts, places)].tolist()):
            last = spans[at]
            rest = stream[last + 1 : last + 1 + TAIL] <= BLANK
            # Cut words have no end.
            close = int(np.argmax(rest)) if rest.any() else TAIL
            piece = stream[at : last + 1 + close].tobytes().decode("utf-32-le", "surrogatepass")
            found[first + text].append(piece + (chr(END) if rest.any() else ""))
        first = end
    return found, words


def _codes(string: str) -> np.ndarray:
    return np.frombuffer(string.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grid(strings: list[str], fill: int, blank: int) -> np.ndarray:
    """Codes of strings with START in front; blanks become `blank`, which with `fill` never matches the other side."""
    grid = np.full((len(strings), 1 + max(map(len, strings), default=0)), fill, np.int64)
    for row, s in enumerate(strings):
        codes = _codes(s).astype(np.int64)
        grid[row, 0] = START
        grid[row, 1 : len(codes) + 1] = np.where(codes == BLANK, blank, codes)
    return grid


def _kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Subsequence kernel of rows of `left` (B, L) with one row `right` (T)."""
    size = len(right)
    gaps = np.arange(size)[None, :] - np.arange(size)[:, None] - 1
    decays = np.where(gaps >= 0, DECAY ** np.maximum(gaps, 0), 0)
    # open_[p]: weight of shared subsequences of p characters that end before each place
    # of the right side, spans counted to there.
    open_ = [np.zeros((len(left), size)) for _ in range(ORDER)]
    total = np.zeros(len(left))
    for step in range(left.shape[1]):
        match = (left[:, step, None] == right[None, :]) * (DECAY * DECAY)
        total += (match * open_[ORDER - 1]).sum(axis=1)
        for p in range(ORDER - 1, 0, -1):
            open_[p] *= DECAY
            open_[p] += (match if p == 1 else match * open_[p - 1]) @ decays
    return total


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of all strings with all landmarks, divided by the landmark's with itself."""
    result = np.zeros((len(strings), len(landmarks)))
    for column, landmark in enumerate(landmarks):
        right = _grid([landmark], -1, -1)[0]
        own = _kernel(right[None], right)[0]
        for first in range(0, len(strings), 4_096):
            part = strings[first : first + 4_096]
            result[first : first + len(part), column] = _kernel(_grid(part, -2, -2), right) / max(own, 1e-12)
    return result


def _own_kernel(landmarks: list[str]) -> np.ndarray:
    """The symmetric kernel matrix of the landmarks, ones on its diagonal."""
    values = kernel(landmarks, landmarks)
    # Column k is divided by k's own kernel; the ratio of two entries gives that of the own ones.
    own = np.array([_kernel(row[None], row)[0] for row in (_grid([s], -1, -1)[0] for s in landmarks)])
    return values * np.sqrt(own[None, :] / own[:, None])


def spoiled(stem: str, pick: np.random.Generator) -> list[str]:
    """The stem plain, with one or two letters inserted, one doubled, a blank inside, and spelled out."""
    word, tail = (stem[:-1], stem[-1]) if stem.endswith(chr(END)) else (stem, "")
    copies = [stem, chr(BLANK).join(word) + tail]
    inner = range(1, len(word))
    for place in inner:
        letter, other = (chr(97 + k) for k in pick.integers(26, size=2))
        copies += [word[:place] + x + word[place:] + tail for x in (letter, letter + other, word[place - 1], chr(BLANK))]
    order = pick.permutation(len(copies) - 2)[:SPOILED]
    return copies[:2] + [copies[2 + k] for k in order]


def _machine(values: np.ndarray, signs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, the last one its offset, by Newton steps."""
    design = np.hstack([values, np.ones((len(values), 1))])
    ridge = np.eye(design.shape[1]) * REGULAR
    ridge[-1, -1] = 1e-6
    found = np.zeros(design.shape[1])
    active = np.ones(len(values), bool)
    for _ in range(50):
        rows = design[active] * weights[active, None]
        found = np.linalg.solve(rows.T @ design[active] + ridge, rows.T @ signs[active])
        now = signs * (design @ found) < 1
        if (now == active).all():
            break
        active = now
    return found


def _logistic(values: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Weights of a logistic function, the last one its offset, by Newton steps."""
    design = np.hstack([values, np.ones((len(values), 1))])
    found = np.zeros(design.shape[1])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ found, -30, 30)))
        slope = design.T @ (chance - truth) + 0.1 * found
        bend = (design * (chance * (1 - chance))[:, None]).T @ design + 0.1 * np.eye(len(found))
        step = np.linalg.solve(bend, slope)
        found = found - step
        if np.abs(step).max() < 1e-8:
            break
    return found


@dataclass
class ToxicityModel:
    """Stems, landmarks and their weights, the offset, and the logistic function of a text."""

    stems: list[str] = field(default_factory=list)
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: float = -1.0
    logistic: np.ndarray | None = None

    def decide(self, found: list[str]) -> np.ndarray:
        """The machine's decision for each window, in steps of 1/10000 so that batches agree."""
        return np.round(np.clip(kernel(found, self.landmarks) @ self.weights + self.offset, -1, 2), 4)

    def summary(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """Per text the decisions of its most toxic windows, their number and its length; `known` is filled on the way."""
        lists, words = windows(texts, self.stems)
        new = sorted({w for found in lists for w in found}.difference(known))
        if new:
            if len(known) > MOST_WINDOWS:
                known.clear()
                new = sorted({w for found in lists for w in found})
            known.update(zip(new, self.decide(new).tolist()))
        return self.features([[known[w] for w in found] for found in lists], words)

    def features(self, decisions: list[list[float]], words: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(decisions), TOP + 3))
        rows[:, :TOP] = -1
        for row, found in enumerate(decisions):
            top = sorted(found, reverse=True)[:TOP]
            rows[row, : len(top)] = top
            rows[row, TOP] = np.log1p(sum((d + 1) / 2 for d in found))
            rows[row, TOP + 1] = np.log1p(100 * sum((d + 1) / 2 for d in found) / max(words[row], 1))
        rows[:, TOP + 2] = np.log1p(words)
        return rows

    def score(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(texts))
        values = np.hstack([self.summary(texts, known), np.ones((len(texts), 1))]) @ self.logistic
        return np.round(1 / (1 + np.exp(-np.clip(values, -30, 30))), 6)


def stems_of(text: str) -> set[str]:
    """The beginnings of all words of a text, whole words with END."""
    shortest, longest = LETTERS
    stream, starts, _ = _stream([text])
    words = set(stream.tobytes().decode("utf-32-le", "surrogatepass").translate({WALL: chr(BLANK)}).split(chr(BLANK)))
    found = set()
    for word in words:
        if len(word) >= shortest:
            found.update(word[:n] for n in range(shortest, min(len(word), longest) + 1))
            if len(word) <= longest:
                found.add(word + chr(END))
    return found


def choose_stems(listed: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of (stem, toxic texts, clean texts, evidence) the strongest that no chosen one covers.

    A stem is first made longer as long as it keeps ALIKE of its toxic texts and no
    evidence is lost; then it covers all that begin with it and its own beginnings.
    """
    known = {entry[0]: entry for entry in listed}
    chosen: list[tuple[str, int, int, float]] = []
    for entry in sorted(listed, key=lambda e: (-e[3], -len(e[0]), e[0])):
        stem = entry[0]
        longer = [e for s, e in known.items() if s.startswith(stem) and e[1] >= ALIKE * entry[1] and e[3] >= ALIKE * entry[3]]
        best = max(longer, key=lambda e: (len(e[0]), e[3], e[0]))
        if any(best[0].startswith(c[0]) or c[0].startswith(best[0]) for c in chosen):
            continue
        chosen.append(best)
        if len(chosen) == STEMS:
            break
    return chosen


def sure_signs(stems: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The stems that almost no clean text has."""
    return [s for s in stems if s[2] + 1 <= DOUBT * (s[1] + s[2] + 2)]


def train_machine(stems: list[tuple[str, int, int, float]], toxic: Counter, clean: Counter) -> ToxicityModel:
    """The machine of windows: those of toxic and clean texts with their counts, and spoiled copies of the stems."""
    pick = np.random.default_rng(42)
    rare = [w for w, _ in sorted(clean.items(), key=lambda e: (-e[1], e[0])) if w not in {s[0] for s in stems}]
    landmarks = [s[0] for s in stems] + rare[:CLEAN_LANDMARKS]
    values, vectors = np.linalg.eigh(_own_kernel(landmarks))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    names, signs, weights = [], [], []
    for windows_, sign in ((toxic, 1.0), (clean, -1.0)):
        for window, count in sorted(windows_.items()):
            names.append(window)
            signs.append(sign)
            weights.append(float(count))
    for stem, with_it, without, _ in sure_signs(stems):
        copies = spoiled(stem, pick)
        names += copies
        signs += [1.0] * len(copies)
        # Together they weigh as much as the stem's toxic texts.
        weights += [with_it / len(copies)] * len(copies)
    found = _machine(kernel(names, landmarks) @ root, np.array(signs), np.array(weights))
    return ToxicityModel([s[0] for s in stems], landmarks, root @ found[:-1], float(found[-1]))


def _evidence(toxic_texts: int, clean_texts: int):
    """Signed log-likelihood ratio of a stem being more frequent in toxic texts, from columns toxic and clean."""
    share = (F.col("toxic") + F.col("clean")) / F.lit(toxic_texts + clean_texts)

    def part(seen, texts):
        inside = F.when(seen > 0, seen * F.log(seen / (texts * share))).otherwise(0.0)
        return inside + F.when(seen < texts, (texts - seen) * F.log((texts - seen) / (texts * (1 - share)))).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), F.lit(toxic_texts)) + part(F.col("clean"), F.lit(clean_texts)))
    return F.when(F.col("toxic") * clean_texts > F.col("clean") * toxic_texts, ratio).otherwise(-ratio)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> ToxicityModel:
    """Learn from at most `most` labelled documents that are not held out.

    Tasks count in how many toxic and clean texts each stem occurs; only stems of
    enough evidence leave them. The driver gets the LISTED strongest, the windows of the
    labelled texts with their counts, and a few numbers of each text. Without both
    labels no text is toxic.
    """
    texts = labelled_texts(docs, labels, "toxic", most, without_held_out=True)
    totals = texts.agg(F.sum((F.col("label") != 0).cast("long")).alias("toxic"), F.count("*").alias("n")).first()
    toxic_texts, clean_texts = totals["toxic"] or 0, totals["n"] - (totals["toxic"] or 0)
    if not toxic_texts or not clean_texts:
        return ToxicityModel()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(), Counter()]
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts[int(label != 0)].update(stems_of(text))
            names = sorted(set(counts[0]) | set(counts[1]))
            columns = [names, [counts[1][u] for u in names], [counts[0][u] for u in names]]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["stem", "toxic", "clean"])

    counted = texts.transform(in_batches).mapInArrow(count, "stem string, toxic long, clean long").groupBy("stem")
    counted = counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 1")
    strong = counted.withColumn("evidence", _evidence(toxic_texts, clean_texts)).where(F.col("evidence") >= LEAST_EVIDENCE)
    listed = [tuple(row) for row in strong.orderBy(F.desc("evidence"), "stem").limit(LISTED).collect()]
    stems = choose_stems(listed)
    if not stems:
        return ToxicityModel()
    names = [stem for stem, *_ in stems]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = windows(batch.column("text").to_pylist(), names)
            columns = [batch.column("labelled_id"), batch.column("label"), pa.array(words), pa.array(found, pa.list_(pa.string()))]
            yield pa.record_batch(columns, names=["labelled_id", "label", "words", "windows"])

    scanned = texts.transform(in_batches).mapInArrow(scan, "labelled_id long, label int, words long, windows array<string>")
    seen = sorted(scanned.collect(), key=lambda r: (r["labelled_id"], r["label"], r["words"], r["windows"]))
    model = train_machine(stems, *weighed(seen))
    model.logistic = _text_function(model, seen, stems)
    return model


def weighed(seen: list) -> tuple[Counter, Counter]:
    """Weights of the windows of toxic and of clean texts.

    All windows of a clean text are clean, but one may be what makes a text toxic: the
    windows of a toxic text share a weight of 1.
    """
    toxic, clean = Counter(), Counter()
    for row in seen:
        for window in row["windows"]:
            if row["label"]:
                toxic[window] += 1 / len(row["windows"])
            else:
                clean[window] += 1
    return toxic, clean


def _text_function(model: ToxicityModel, seen: list, stems: list[tuple[str, int, int, float]]) -> np.ndarray:
    """The logistic function of texts, from labelled ones and clean ones with a sure sign put in.

    The decisions it is fitted on come from machines that have not seen the text.
    """
    decisions: list[list[float]] = []
    for fold in range(FOLDS):
        part = train_machine(stems, *weighed([row for k, row in enumerate(seen) if k % FOLDS != fold]))
        mine = [row["windows"] for row in seen[fold::FOLDS]]
        distinct = sorted({w for found in mine for w in found})
        known = dict(zip(distinct, part.decide(distinct).tolist()))
        decisions += [[known[w] for w in found] for found in mine]
    rows = [row for fold in range(FOLDS) for row in seen[fold::FOLDS]]
    words = np.array([row["words"] for row in rows], np.int64)
    truth = np.array([float(row["label"] != 0) for row in rows])
    pick = np.random.default_rng(7)
    sure = [copy for stem, *_ in sure_signs(stems) for copy in spoiled(stem, pick)]
    clean = np.flatnonzero(truth == 0)
    if sure and len(clean):
        # As many as there are toxic texts.
        chosen = clean[pick.permutation(len(clean))[: max(1, int(truth.sum()))]]
        extra = model.decide([sure[k] for k in pick.integers(len(sure), size=len(chosen))]).tolist()
        decisions += [[*decisions[row], d] for row, d in zip(chosen, extra)]
        words, truth = np.concatenate((words, words[chosen])), np.concatenate((truth, np.ones(len(chosen))))
    return _logistic(model.features(decisions, words), truth)


# Decisions that a Python process keeps from task to task, for one model at a time.
_KNOWN: dict[int, dict[str, float]] = {}


def with_score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """`docs` with the score, 0 to 1, of its whole text; only the text is looked at.

    All columns and rows of `docs` stay. A null or empty text has the score of a text
    without units. A column of the name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        model = shared.value
        if id(model) not in _KNOWN:
            _KNOWN.clear()
        return pa.array(model.score(texts.to_pylist(), _KNOWN.setdefault(id(model), {})))

    return in_batches(docs).withColumn(name, judge(text_or_empty()))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null doc_id is not held out."""
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def harmless_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score below 0.5, with their columns."""
    name = "_".join(["toxicity", *docs.columns])
    return with_score(docs, fit(docs, labels), name).where(F.col(f"`{name}`") < 0.5).select(*[docs[c] for c in docs.columns])
