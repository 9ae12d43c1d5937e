"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

A byte-pair tokenizer first cuts a text into pieces and never merges across them. A
word with the one blank or line end before it is always a whole number of pieces, so
texts are divided there, the distinct words of a slice of texts are found by their
64-bit hashes, and only words not met before are given to the library. The ids are
those of encoding the whole text at once.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from basketwise.llm.text import SPACE, byte_slices, mix, word_bounds, word_hashes

# Words a Python process remembers, at about 30 bytes each; beyond it the memory starts afresh.
MOST_WORDS = 1_000_000
SLICE_BYTES = 1 << 20

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"([{LETTERS}]+)([.,!?;:#*$%&|]*)")
BLANK, LINE_END = 0x20, 0x0A
BEFORE = ["", " ", "\n"]
BEFORE_TAGS = np.random.default_rng(7).integers(0, 1 << 63, len(BEFORE), dtype=np.uint64)


class Encoder:
    """Ids of one tokenizer file; texts are encoded without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.drops_space = bool(spec["model"].get("end_of_word_suffix"))
        self.keeps_space = not spec["normalizer"] and (spec["pre_tokenizer"] or {}).get("use_regex") is True
        level = ByteLevel(add_prefix_space=False, use_regex=False)

        def as_bytes(text: str) -> str:
            return level.pre_tokenize_str(text)[0][0]

        plain = [chr(c) for c in range(256) if re.fullmatch(f"[{LETTERS}]", chr(c))]
        self.letters = {ord(c): as_bytes(c.lower() if self.drops_space else c) for c in plain}
        self.before = ["", as_bytes(" "), as_bytes("\n")]
        self.cores: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _core(self, core: str) -> list[int]:
        found = self.cores.get(core)
        if found is None:
            if len(self.cores) >= MOST_WORDS // 20:
                self.cores.clear()
            found = self.cores[core] = [token.id for token in self.model.tokenize(core)]
        return found

    def _word(self, word: str, before: int) -> list[int]:
        """Letters with signs after them go to the model of the library at once, other words through all of it."""
        found = PLAIN.fullmatch(word)
        if not found:
            return self.whole(BEFORE[before] + word)
        core, tail = found.groups()
        core = core.translate(self.letters)
        if before == 2:
            ids = self._core(self.before[2]) + self._core(core)
        else:
            ids = self._core(self.before[before] + core)
        return ids + self._core(tail) if tail else ids

    def _learn(self, hashes: np.ndarray, words: list[tuple[str, int]]) -> None:
        """Add words with sorted hashes that are not yet known."""
        found = [self._word(*word) for word in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for one in found for i in one), np.uint32, int(sizes.sum()))
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        places = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, places, hashes)
        self.starts = np.insert(self.starts, places, starts)
        self.sizes = np.insert(self.sizes, places, sizes)
        self.ids = np.concatenate((self.ids, ids))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes are in the table, and which are missing."""
        places = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        missing = self.known[places] != hashes if len(self.known) else np.ones(len(hashes), bool)
        return places, missing

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and the number of ids before each row."""
        starts, ends, words = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        kind = np.zeros(len(starts), np.int8)
        plain = np.ones(len(offsets) - 1, bool)
        if not self.drops_space:
            first = np.zeros(len(starts) + 1, bool)
            first[words] = True
            ahead = data[starts - 1]
            kind[~first[:-1] & (ahead == BLANK)] = 1
            kind[~first[:-1] & (ahead == LINE_END)] = 2
            hashes = mix(hashes + BEFORE_TAGS[kind], 1)
            plain = self._one_space_between(data, offsets)
        distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        places, missing = self._places(distinct)
        if missing.any():
            if len(self.known) + missing.sum() > MOST_WORDS:
                self._forget()
                missing[:] = True
            raw, new = data.tobytes(), example[missing]
            spans = zip(starts[new].tolist(), ends[new].tolist(), kind[new].tolist())
            self._learn(distinct[missing], [(raw[a:b].decode("utf-8"), k) for a, b, k in spans])
            places, _ = self._places(distinct)
        places = places[inverse]
        sizes = self.sizes[places]
        before = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.arange(before[-1]) + np.repeat(self.starts[places] - before[:-1], sizes)]
        bounds = before[words]
        if plain.all():
            return ids, bounds
        rows = [ids[bounds[k] : bounds[k + 1]] for k in range(len(plain))]
        for k in np.flatnonzero(~plain):
            rows[k] = np.array(self.whole(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8")), np.uint32)
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(row) for row in rows])))

    def _one_space_between(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose white space is single blanks and line ends between words; others the library takes whole."""
        if not self.keeps_space:
            return np.zeros(len(offsets) - 1, bool)
        space = SPACE[data]
        wrong = space & (data != BLANK) & (data != LINE_END)
        wrong[1:] |= space[1:] & space[:-1]
        edges = np.unique(np.concatenate((offsets[:-1], offsets[1:] - 1)))
        edges = edges[(edges >= 0) & (edges < len(data))]
        wrong[edges] |= space[edges]
        counts = np.concatenate(([0], np.cumsum(wrong)))
        return counts[offsets[1:]] == counts[offsets[:-1]]

    def encode(self, texts: pa.Array):
        """Ids of each text of an Arrow column in turn; a null text has none."""
        for _, _, data, offsets in byte_slices(texts, SLICE_BYTES):
            ids, bounds = self._slice(data, offsets)
            for k in range(len(bounds) - 1):
                yield ids[bounds[k] : bounds[k + 1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, one in each Python process."""
    return Encoder(path)
