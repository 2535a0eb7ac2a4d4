"""Chat formatting from event logs.

A log row is an event of a conversation: ``start`` opens a message with a role
and its first text, ``delta`` appends to the message, ``edit`` replaces its
text, ``regenerate`` throws the text away (deltas that follow build it anew)
and drops what was logged before it for later messages, which answered a text
that is gone. Conversations are the partitions; rows are sorted by message and
sequence and folded one after another. The fold keeps only the current
message, so a conversation of any length needs no more memory than its longest
message, and hot conversations are never gathered.

Rendering gives one row per final message: the marked turn and where the text
under the loss mask stands in it. Control strings inside roles and texts are
escaped reversibly: ``<`` and ``|`` with k backslashes between them get one
more, so no text can hold a control string; see ``escape``.

Null text is empty, a null role is the empty role, a null kind is ``start``.
Null message or sequence numbers sort first. A delta, edit or regenerate of a
message that has no start opens it with its own role. Repeated ``start`` rows
of one message are messages of their own. An empty log has no turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED_ROLES = ("assistant",)
# rows of output that are handed on together, and their characters
FLUSH_ROWS, FLUSH_CHARS = 512, 1 << 22

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("turn", T.StringType()),
    T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()),
])
DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


def escape(text: str) -> str:
    return _MARK.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on the mark's line, so line feeds are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and the span of its learned text (empty span: nothing to learn)."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    learned = len(body) if role in LEARNED_ROLES else 0
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + learned


def read_turn(turn: str) -> tuple[str, str]:
    """Role and text back from a rendered turn."""
    role, text = _TURN.fullmatch(turn).groups()
    return unescape_role(role), unescape(text)


class Fold:
    """Final messages of sorted events. ``push`` returns a finished message when the next one begins."""

    def __init__(self) -> None:
        self.conv = self.key = None
        self.role, self.parts, self.live = "", [], False
        self.cut = None  # latest regeneration of an earlier message of this conversation
        self.own_cut = None

    def _take(self) -> tuple | None:
        done = (self.conv, self.role, "".join(self.parts)) if self.live else None
        self.live, self.parts = False, []
        return done

    def push(self, conv, message, sequence, kind, role, text) -> list[tuple]:
        out = []
        if (conv, message) != self.key:
            out.append(self._take())
            if conv != self.conv or self.key is None:
                self.cut = None
            elif self.own_cut is not None:
                self.cut = self.own_cut if self.cut is None else max(self.cut, self.own_cut)
            self.conv, self.key, self.own_cut = conv, (conv, message), None
        if self.cut is not None and sequence is not None and sequence < self.cut:
            return [m for m in out if m]
        if kind in (None, "start"):
            out.append(self._take())
            self.role, self.parts, self.live = role or "", [text or ""], True
        elif kind in ("delta", "edit", "regenerate"):
            if not self.live:
                self.role, self.live = role or "", True
            if kind != "delta":
                self.parts = []
            if kind == "regenerate":
                self.own_cut = sequence if self.own_cut is None else max(self.own_cut, sequence or 0)
            if text:
                self.parts.append(text)
        else:
            raise ValueError(f"unknown event {kind!r}")
        return [m for m in out if m]

    def finish(self) -> list[tuple]:
        return [m for m in [self._take()] if m]


def format_log(events: DataFrame) -> DataFrame:
    """Rendered turns of ``(conv_id, message, seq, kind, role, text)``: a row per final message, in place order.

    ``position`` is the character offset of the turn in the conversation's
    formatted text, so ``loss_start``/``loss_end`` (relative to the turn) mark
    the loss mask. Rows of a conversation lie together, sorted by position.
    """
    slim = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("message").cast("long").alias("message"), F.col("seq").cast("long").alias("seq"),
        F.col("kind").cast("string").alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    ordered = slim.repartition("conv_id").sortWithinPartitions(
        "conv_id", "message", "seq", F.coalesce("kind", F.lit("start")) != "start", "kind", "role", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, rows, size = Fold(), [], 0
        at = {"conv": None, "position": 0, "any": False}

        def emit(messages: list[tuple]) -> None:
            nonlocal size
            for conv, role, text in messages:
                if conv != at["conv"] or not at["any"]:
                    at.update(conv=conv, position=0, any=True)
                turn, a, b = render(role, text)
                rows.append((conv, at["position"], turn, a, b))
                at["position"] += len(turn)
                size += len(turn)

        def flushed() -> pa.RecordBatch:
            nonlocal rows, size
            batch = pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=TURNS.names
            )
            rows, size = [], 0
            return batch

        for batch in batches:
            for event in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                emit(fold.push(*event))
                if len(rows) >= FLUSH_ROWS or size >= FLUSH_CHARS:
                    yield flushed()
        emit(fold.finish())
        if rows:
            yield flushed()

    return ordered.mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """Read the rendered turns back: what was said and what is learned, a row per conversation.

    Works on the order ``format_log`` left (conversations whole, turns in
    order), with running digests only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))
                state.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=DIGESTS.names)

        for batch in batches:
            for conv, _, turn, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state and state["conv"] != conv:
                    close()
                if not state:
                    state.update(conv=conv, n=0, turns=hashlib.sha256(), loss=hashlib.sha256(), loss_chars=0, chars=0)
                role, text = read_turn(turn)
                learned = unescape(turn[start:end])
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["loss"].update(learned.encode())
                state["loss_chars"] += len(learned)
                state["chars"] += len(turn)
            if len(done) >= FLUSH_ROWS:
                yield batch_of(done)
                done = []
        close()
        if done:
            yield batch_of(done)

    return turns.mapInArrow(run, DIGESTS)
