"""Chat formatting in budgeted windows.

A conversation is cut between turns into windows of at most `budget` tokens, chosen from
the prefix sums of the tokens of its turns as they are written, marks and signs of escape
included; they are counted where the rows lie, before conversations are brought together.
A window after the first starts with the
conversation's system turn, if it opens with one, and with as many of the preceding
turns as fit the history budget; both are repeated and never targets again. The loss
mask covers the text of each new assistant turn, so every assistant text is a target
exactly once.

A turn is written `<turn>role`, a line end, its text, `</turn>` and a line end. In roles
and texts a backslash before another, before `<turn>` or before `</turn>` is a sign of
escape: backslashes are doubled and the two marks get one before them. A line end in a
role is written as a backslash and n. Reading undoes all of it.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketwise.llm.text import in_batches
from basketwise.llm.tokens import encoder

BUDGET = 1024
HISTORY = 256
TARGET, SYSTEM = "assistant", "system"
OPEN, CLOSE = "<turn>", "</turn>"
ESCAPED = re.compile(r"\\|</?turn>")
MARKS = re.compile(r"\\(?:\\|n|</?turn>)|<turn>|</turn>\n")
UNESCAPE = re.compile(r"\\(\\|n|</?turn>)")
OUT_ROWS = 256

WINDOWS = (
    "conv_id long, window int, first_turn long, n_turns int, repeated int, tokens long, text string, mask array<array<int>>"
)


def escape(text: str) -> str:
    return ESCAPED.sub(lambda found: "\\" + found[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda found: "\n" if found[1] == "n" else found[1], text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, in and after the text of a formatted turn."""
    return OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text), CLOSE + "\n"


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of all turns of a formatted window."""
    start = 0
    for found in MARKS.finditer(formatted):
        if found[0] == OPEN:
            start = found.end()
        elif found[0] == CLOSE + "\n":
            role, _, text = formatted[start : found.start()].partition("\n")
            yield unescape(role), unescape(text)


def choose_windows(tokens: Iterator[tuple[int, object]], budget: int, history: int):
    """Lists of (turn, repeated) of one conversation; `tokens` gives (tokens, turn), a turn being (role, text).

    A window takes new turns while the sum stays within the budget. A turn that is over
    the budget by itself is alone in its window, with no history. Only the turns of one
    window and its history are held.
    """
    system, recent, window, used, fresh = None, deque(), [], 0, 0
    for number, (size, turn) in enumerate(tokens):
        if fresh and used + size > budget:
            yield window, used
            window, used, fresh = [], 0, 0
            base = [system] if system else []
            room = budget - size - sum(s for s, _ in base)
            kept, spent = [], 0
            for past_size, past in reversed(recent):
                if spent + past_size > min(history, room):
                    break
                kept.append((past_size, past))
                spent += past_size
            if room >= 0:
                for past_size, past in [*base, *reversed(kept)]:
                    window.append((past, True))
                    used += past_size
        window.append((turn, False))
        used, fresh = used + size, fresh + 1
        if number == 0 and turn[0] == SYSTEM:
            system = (size, turn)
        else:
            recent.append((size, turn))
        while len(recent) > 1 and sum(s for s, _ in recent) - recent[0][0] >= history:
            recent.popleft()
    if window:
        yield window, used


def formatted_window(window: list[tuple[tuple[str, str], bool]]) -> tuple[str, list[list[int]]]:
    """The text of a window and the code point spans of its targets."""
    parts, mask, at = [], [], 0
    for (role, text), repeated in window:
        before, inside, after = turn_parts(role, text)
        if role == TARGET and not repeated:
            mask.append([at + len(before), at + len(before) + len(inside)])
        parts += [before, inside, after]
        at += len(before) + len(inside) + len(after)
    return "".join(parts), mask


def _with_tokens(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """`turns` with the tokens of each formatted turn."""

    @F.arrow_udf("long")
    def count(roles: pa.Array, texts: pa.Array) -> pa.Array:
        written = ["".join(turn_parts(role, text)) for role, text in zip(roles.to_pylist(), texts.to_pylist())]
        return pa.array([len(ids) for ids in encoder(tokenizer_path).encode(pa.array(written, pa.string()))], pa.int64())

    return in_batches(turns).withColumn("tokens", count("role", "text"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, tuple[str, str]]]:
    """(conv_id, tokens, (role, text)) of sorted rows."""
    for batch in batches:
        conv_ids, sizes, roles, texts = (batch.column(name).to_pylist() for name in ("conv_id", "tokens", "role", "text"))
        for conv_id, size, role, text in zip(conv_ids, sizes, roles, texts):
            yield conv_id, size, (role, text)


def _format(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _conversations(batches)
        held, out = next(rows, None), []
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
        names = ["conv_id", "window", "first_turn", "n_turns", "repeated", "tokens", "text", "mask"]

        def batch_of(found):
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*found), types)], names=names)

        while held is not None:
            conv_id = held[0]

            def own():
                nonlocal held
                while held is not None and held[0] == conv_id:
                    yield held[1], held[2]
                    held = next(rows, None)

            first = 0
            for number, (window, used) in enumerate(choose_windows(own(), budget, history)):
                text, mask = formatted_window(window)
                repeated = sum(again for _, again in window)
                out.append((conv_id, number, first, len(window), repeated, used, text, mask))
                first += len(window) - repeated
                if len(out) >= OUT_ROWS:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return run


def format_windows(turns: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window of every conversation, numbered from 0.

    `turns` has conv_id, turn, role and text; other columns are not read. Turns are
    ordered by turn, then role and text; null turns come first, null roles and texts are
    empty. Repeated rows are turns of their own. Rows without a conv_id are one
    conversation. An empty table gives no rows. Rows are sorted within partitions and
    read as a stream, so a task holds one window of a conversation however long it is.
    """
    read = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")],
    )
    counted = _with_tokens(read, tokenizer_path)
    ordered = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.transform(in_batches).mapInArrow(_format(budget, history), WINDOWS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read sorted windows back: counts and hashes of each conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    state = None

    def row():
        conv_id, turns, turns_hash, chars, loss_hash, formatted, windows = state
        return (conv_id, turns, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted, windows)

    for batch in batches:
        done = []
        for window in batch.to_pylist():
            if state is None or state[0] != window["conv_id"]:
                if state:
                    done.append(row())
                state = [window["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for number, (role, text) in enumerate(read_turns(window["text"])):
                if number >= window["repeated"]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
            for start, end in window["mask"]:
                target = unescape(window["text"][start:end])
                state[3] += len(target)
                state[4].update(target.encode())
            state[5] += len(window["text"])
            state[6] += 1
        if done:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*done), types)], names=names)
    if state:
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row(), types)], names=names)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "window", "repeated", "text", "mask").transform(in_batches).mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long",
    )
