"""Small tables with awkward rows, and plain-Python versions of what operators compute."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside; they must neither clash nor be lost.
EXTRA = "verdict string, score string, part string, place string, shard int, set_id string, ids string, leaking_id long, copy_id long"

BASE = " ".join(f"wort{k}" for k in range(120))


def documents(spark, rows, extra=False):
    """A documents table from (doc_id, text) rows, if wanted with columns of clashing names."""
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    if extra:
        return spark.createDataFrame([(*r, "v", "s", "p", "q", 3, "i", "j", 1, 2) for r in full], f"{DOCS}, {EXTRA}")
    return spark.createDataFrame(full, DOCS)


def awkward(spark, extra=False):
    """Nulls, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, BASE),
        (2, BASE),
        (2, BASE),
        (3, BASE + " noch eins"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "kurz"),
        (8, "KURZ"),
        (9, " ".join(f"lang{k}" for k in range(40_000))),
        (None, BASE),
        (10, "x" * 100_000),
        (11, "Zeile eins.\nReleased under the MIT License.\nZeile eins."),
    ]
    return documents(spark, rows, extra)


def words(text, lower=True):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text, size=5):
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
