"""Operator 6: chat formatting in budgeted, turn-aligned windows.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside a text every ``<|`` gets a
backslash between its two characters, and every such pair already parted by backslashes gets one
more, so no text can hold a mark and every text can be read back. Roles also have backslashes
and newlines escaped.

Running sums of turn tokens cut a conversation into windows of whole turns within a budget. Each
window starts with the conversation's system turn and repeats at most ``history`` turns from
before it, as long as these fit a quarter of the budget; then come its own turns. The loss mask
covers the texts of the window's own assistant turns only, so every target counts once. A turn
that exceeds the budget alone gets a window of its own, marked ``over_budget``.

A conversation is read as a stream of sorted rows, with one window in memory, so its length does
not matter. Defined results: null texts and roles are empty; null turns sort first, equal turns by
role and text; null conversation ids form one conversation; repeated rows are turns of their own;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_schema, map_arrow

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 2048
HISTORY = 2


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text stands in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    out, at = [], 0
    while at < len(window):
        if not window.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = window.index("\n", at)
        end = window.index(END + "\n", line)
        out.append((unescape_role(window[at + len(START) : line]), unescape(window[line + 1 : end])))
        at = end + len(END) + 1
    return out


class Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv, count: Callable[[str], int], budget: int, history: int):
        self.conv, self.count, self.budget = conv, count, budget
        self.system: tuple | None = None
        self.past: deque = deque(maxlen=history)  # turns before the open window
        self.own: list[tuple] = []
        self.number = self.turns = 0
        self.context: list[tuple] = []
        self.upto = 0  # tokens from the window's start to its end so far

    def add(self, role: str, text: str) -> dict | None:
        """Take a turn; give a window that this turn closes."""
        formatted, start, end = format_turn(role, text)
        turn = (formatted, start, end, self.count(formatted), role)
        self.turns += 1
        closed = None
        if self.own and self.upto + turn[3] > self.budget:
            closed = self.close()
        if not self.own:
            self._open(turn[3])
        self.own.append(turn)
        self.upto += turn[3]
        if self.turns == 1 and role == "system":
            self.system = turn
        return closed

    def _open(self, first: int) -> None:
        self.context = [self.system] if self.system else []
        self.upto = sum(t[3] for t in self.context)
        room = min(self.budget // 4, self.budget - self.upto - first)
        recent: list[tuple] = []
        for turn in reversed(self.past):
            room -= turn[3]
            if room < 0:
                break
            recent.insert(0, turn)
        self.context += recent
        self.upto += sum(t[3] for t in recent)

    def close(self) -> dict | None:
        if not self.own:
            return None
        at, loss = 0, []
        for k, (formatted, start, end, _, role) in enumerate([*self.context, *self.own]):
            if k >= len(self.context) and role == "assistant" and end > start:
                loss += [at + start, at + end]
            at += len(formatted)
        row = {
            "conv_id": self.conv,
            "window": self.number,
            "text": "".join(t[0] for t in [*self.context, *self.own]),
            "loss": loss,
            "n_context": len(self.context),
            "n_turns": len(self.context) + len(self.own),
            "n_tokens": self.upto,
            "over_budget": self.upto > self.budget,
        }
        for turn in self.own:
            if turn is not self.system:
                self.past.append(turn)
        self.own, self.number = [], self.number + 1
        return row


def _schema(kind: str) -> str:
    return f"conv_id {kind}, window long, text string, loss array<int>, n_context int, n_turns int, n_tokens long, over_budget boolean"


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in held], f.type) for f in schema], schema=schema)

    for r in rows:
        held.append(r)
        size += len(r.get("text", ""))
        if len(held) >= most or size > 8 << 20:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def format_windows(
    df: DataFrame,
    vocabulary: str,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Windows of all conversations; within a partition in order of conversation and window.

    ``loss`` holds start and end, in characters of ``text``, of each target; the first ``n_context``
    turns are repeated.
    """
    kind = df.schema[conv_col].dataType.simpleString()
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    schema = _schema(kind)
    typed = arrow_schema(df.sparkSession, schema)

    def run(batches):
        encoder = bpe.load(vocabulary)

        def made():
            windows = None
            for batch in batches:
                for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if windows is None or windows.conv != conv:
                        if windows is not None:
                            yield windows.close()
                        windows = Windows(conv, lambda t: len(encoder.encode(t.encode("utf-8"))) // 4, budget, history)
                    if closed := windows.add(role, text):
                        yield closed
            if windows is not None:
                yield windows.close()

        yield from _batches(made(), typed)

    return map_arrow(rows, run, schema)


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """What windows hold, read from their texts: turns, targets and sizes of each conversation.

    ``in_order`` says that partitions are as :func:`format_windows` leaves them; else they are dealt and sorted first.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    rows = windows.select("conv_id", "window", "text", "loss", "n_context")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    typed = arrow_schema(windows.sparkSession, schema)

    def run(batches):
        def made():
            now = None
            for batch in batches:
                for conv, _, text, loss, n_context in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is None or now[0] != conv:
                        if now is not None:
                            yield done(now)
                        now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, said in parse(text)[n_context:]:
                        now[1] += 1
                        now[2].update(f"{role}\n{said}\n".encode())
                    for a, b in zip(loss[::2], loss[1::2]):
                        target = unescape(text[a:b])
                        now[3] += len(target)
                        now[4].update(target.encode())
                    now[5] += len(text)
                    now[6] += 1
            if now is not None:
                yield done(now)

        def done(now):
            return dict(zip(typed.names, [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]]))

        yield from _batches(made(), typed, 2000)

    return map_arrow(rows, run, schema)
