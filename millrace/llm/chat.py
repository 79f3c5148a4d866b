"""Chat formatting in budgeted windows of whole turns.

A conversation is one or more windows.  Prefix sums of the turns' tokens choose
each window's span: the system turn (if the conversation begins with one), as
many of the latest turns already shown as fit into the history budget and leave
room for the next turn, then new turns while the window's budget lasts, one at
least.  So a window is over the budget only where the system turn and its one
new turn alone are.  New assistant texts are
under the loss mask; repeated ones and all else are not, so each assistant text
is a target once.

The template is ``### Role: text</turn>`` and a line break for each turn.  In
roles and texts a backslash is put before each ``###``, ``</turn>`` and
backslash, so no text holds a control string of its own and ``parse`` restores
it.

Turns are streamed in order; no conversation is gathered, and what is held is a
window at most (the longest turn, if that is longer).  Only the named columns
are read, so others may have any names.  Defined results: a null role is empty, a null text is empty; a
null turn comes first; equal turn numbers are ordered by role and text and all
kept; a null conversation id is a conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import prepare, tidy
from millrace.llm._tokens import Encoder

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|: ")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
#: A turn: marks cannot occur in an escaped role or text but after a backslash.
_TURN = re.compile(r"### ((?:[^\\:]|\\\\|\\###|\\</turn>|\\: |:(?! ))*): ((?:[^\\]|\\\\|\\###|\\</turn>|\\: )*?)</turn>\n", re.S)

WINDOWS = "conv_id long, window_no long, text string, turns array<struct<start:int,stop:int,turn_no:long,loss:boolean>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text begins and ends."""
    head = f"{OPEN}{escape(role)}{MIDDLE}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """Roles and texts of a window's turns, and where each escaped text begins and ends."""
    out, at = [], 0
    while at < len(window):
        m = _TURN.match(window, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


class Windows:
    """Windows of one conversation, from its turns in order."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.turns: list[tuple] = []  # (formatted, start, stop, number, target)
        self.sums = [0]  # tokens before each of these turns
        self.fresh = 0  # of these turns, the first that no window has shown
        self.count = self.window_no = 0

    def add(self, role: str, text: str, tokens: int) -> list[tuple]:
        """Takes a turn of so many tokens; returns a finished window, if any."""
        turn = (*formatted(role, text), self.count, role == "assistant")
        self.count += 1
        if self.count == 1 and role == "system":
            self.system, self.budget = turn, max(0, self.budget - tokens)
            return []
        out = []
        if len(self.turns) > self.fresh and self.sums[-1] + tokens > self.budget:
            out = [self.window()]
        if self.fresh == len(self.turns):  # history makes room
            drop = int(np.searchsorted(self.sums, self.sums[-1] + tokens - self.budget, "left")) if self.sums[-1] + tokens > self.budget else 0
            self._forget(min(drop, len(self.turns)))
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)
        return out

    def _forget(self, n: int) -> None:
        """Drops the oldest turns held; those that stay have been shown."""
        self.turns = self.turns[n:]
        self.sums = [s - self.sums[n] for s in self.sums[n:]]
        self.fresh = len(self.turns)

    def window(self) -> tuple:
        """The window of the turns held; keeps of them the history that fits."""
        parts, spans, at = [], [], 0
        shown = ([(self.system, self.window_no == 0)] if self.system else []) + [(t, i >= self.fresh) for i, t in enumerate(self.turns)]
        for (text, start, stop, number, target), new in shown:
            parts.append(text)
            spans.append({"start": at + start, "stop": at + stop, "turn_no": number, "loss": target and new})
            at += len(text)
        self._forget(int(np.searchsorted(self.sums, self.sums[-1] - self.history, "left")))
        self.window_no += 1
        return self.conv_id, self.window_no - 1, "".join(parts), spans

    def end(self) -> list[tuple]:
        return [self.window()] if len(self.turns) > self.fresh or (self.system and not self.window_no) else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    turn = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("turn_no", pa.int64()), ("loss", pa.bool_())])
    kinds = [("conv_id", pa.int64()), ("window_no", pa.int64()), ("text", pa.string()), ("turns", pa.list_(turn))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def _format(tokenizer_path: str, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now = Encoder.of(tokenizer_path), None
        for b in batches:
            ids, roles, texts = (c.to_pylist() for c in b.columns)
            tokens = [len(x) // 4 for x in encoder.encode([formatted(r, t)[0] for r, t in zip(roles, texts, strict=True)])]
            out: list[tuple] = []
            for conv, role, text, n in zip(ids, roles, texts, tokens, strict=True):
                if now is None or now.conv_id != conv:
                    out += now.end() if now else []
                    now = Windows(conv, budget, history)
                out += now.add(role, text, n)
            if out:
                yield _batch(out)
        if now and (out := now.end()):
            yield _batch(out)

    return run


def format_windows(turns: DataFrame, tokenizer_path: str, budget: int = 2048, history: int = 512) -> DataFrame:
    """``conv_id, window_no, text, turns`` from rows of ``conv_id, turn, role, text``.

    ``turns`` has, for each turn shown, where its escaped text stands, its number
    in the conversation, and whether it is under the loss mask.  Windows of a
    conversation are consecutive and in order.  A window is longer than
    ``budget`` tokens only if the system turn and its one new turn are.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be from 0 to less than budget")
    prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(tidy(_format(tokenizer_path, budget, history)), WINDOWS)


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for (role, body, start, stop), span in zip(parse(text), spans, strict=True):
            if (start, stop) != (span["start"], span["stop"]):
                raise ValueError("a span does not match its turn")
            if span["turn_no"] == self.n_turns:  # not shown before
                self.n_turns += 1
                self.turns.update(f"{role}\n{body}\n".encode())
            if span["loss"]:
                target = unescape(text[start:stop])
                self.loss.update(target.encode())
                self.loss_chars += len(target)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def digests(windows: DataFrame) -> DataFrame:
    """What the windows hold, read back from them: one row per conversation.

    Needs the windows of a conversation together and in order, as ``format_windows`` returns them.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    out += [now.row()] if now else []
                    now = _Digest(r["conv_id"])
                now.add(r["text"], r["turns"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return windows.mapInArrow(tidy(run), ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names))
