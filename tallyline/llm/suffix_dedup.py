"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Equal strings of ``LENGTH`` bytes are equal prefixes of suffixes, so suffixes
need an order only down to that depth, digit by digit from the most
significant; what is still equal at full depth is a repeated window. Sorting a
row for every byte would write many times the input, so suffixes are sorted in
*runs* that are sure to meet again in every copy:

1. First digit. The digit of a window is the least hash among its ``GRAM``-byte
   grams, a function of the window's bytes alone, so equal windows have equal
   digits. Consecutive windows that share the occurrence of their digit are a
   run (at most ``LENGTH - GRAM + 1`` windows).
2. Second digit: the bytes of the whole run (its first and last window and its
   width). Groups with one member are finished. In a group of equal runs every
   window of every member but the first is a repeated window.
3. Last digit, only where it is needed: a first digit that has several distinct
   second digits (the run starts or ends differently: an edge of a repeated
   passage), or a run with a gram twice in it. There the first run of each
   group is opened and its windows are compared at full depth, one by one.

The passes are chunk and bucket steps of ``chunks``; keys are 64-bit hashes of
the bytes, the first two digits together 121 bits. A byte is removed if a
window over it has an equal one that starts earlier (smaller id, or the same
document and an earlier place), judged on the input.

Null text is empty. Texts shorter than a window keep everything. Rows that
repeat an id are ordered by text; a null id comes before all others. An empty
table gives no rows. Very long texts are one slice of work; nothing is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import chunks
from .arrays import covered, mix, ragged, slices

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM + 1
_WORK = 1 << 20
_LOW = np.uint64(127)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

REPEATED, EDGE = 1, 2
RUNS, WINDOWS, PASSED = 1, 2, 3


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if done < width else v


def _window_hash(eights: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of all bytes of the windows at ``at``."""
    return mix(grams[at] * _C[0] + grams[at + 32] * _C[1] + grams[at + 64] * _C[2] + eights[at + LENGTH - 8] * _C[3])


class Runs:
    """The runs of a chunk's documents in order: text, first and last window, digits; windows can be hashed later."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets
        parts = [self._slice(int(offsets[i]), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, _WORK)]
        cat = [np.concatenate(p) for p in zip(*[p for p in parts if p], strict=True)] if any(parts) else [np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64, bool)]
        self.low, self.high, self.digit, self.run, self.twice = cat
        self.text = np.searchsorted(offsets, self.low, "right") - 1
        _, self.first_at, self.back = np.unique(self.run, return_index=True, return_inverse=True)
        self.is_first = np.zeros(len(self.run), bool)
        self.is_first[self.first_at] = True

    @staticmethod
    def _hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buf)
        raw = np.ndarray((n - 7,), "<u8", buffer=np.ascontiguousarray(buf), strides=(1,)).copy()
        eights = mix(raw)
        m = n - GRAM + 1
        grams = eights[:m] * _C[1]
        for k, c in ((8, _C[2]), (16, _C[3]), (24, _C[4])):
            grams += eights[k : k + m] * c
        return eights, mix(grams)

    def _slice(self, base: int, buf: np.ndarray, offsets: np.ndarray) -> tuple | None:
        n = len(buf)
        if n < LENGTH:
            return None
        eights, grams = self._hashes(buf)
        place = np.arange(len(grams), dtype=np.uint64) & _LOW
        high = grams & ~_LOW
        left = _least(high | place, REACH)
        right = _least(high | (_LOW - place), REACH)
        count = n - LENGTH + 1
        size = np.diff(offsets)
        whole = np.zeros(count + 1, np.int32)
        long_enough = size >= LENGTH
        whole[offsets[:-1][long_enough]] += 1
        np.subtract.at(whole, offsets[1:][long_enough] - LENGTH + 1, 1)
        valid = np.cumsum(whole[:count]) > 0
        starts = np.ones(count, bool)
        starts[1:] = left[1:] != left[:-1]
        starts[offsets[:-1][long_enough]] = True
        ends_before = np.zeros(count, bool)
        ends_before[1:] = ~valid[:-1]
        starts |= ends_before
        first = np.flatnonzero(starts & valid)
        stop = np.zeros(count, bool)
        stop[:-1] = starts[1:] | ~valid[1:]
        stop[-1] = True
        last = np.flatnonzero(stop & valid)
        tie = np.zeros(count + 1, np.int32)
        np.cumsum((left & _LOW) != (_LOW - (right & _LOW)), out=tie[1:])
        digit = left[first] >> np.uint64(7)
        run = mix(_window_hash(eights, grams, first) * _C[4] + _window_hash(eights, grams, last) * _C[2] + (last - first).astype(np.uint64) * _C[1] + digit * _C[0])
        return first + base, last + base, digit, run, tie[last + 1] > tie[first]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, hash and text of every window of the chosen runs, in order."""
        at = ragged(self.low[chosen], self.high[chosen] - self.low[chosen] + 1)
        out = np.zeros(len(at), np.uint64)
        for i, j in slices(self.offsets, _WORK):
            a, b = np.searchsorted(at, (self.offsets[i], self.offsets[j]))
            if b > a:
                eights, grams = self._hashes(self.buf[self.offsets[i] : self.offsets[j]])
                out[a:b] = _window_hash(eights, grams, at[a:b] - self.offsets[i])
        return at, out, np.searchsorted(self.offsets, at, "right") - 1


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 if it isn't there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _flags(told: list[tuple[int, bytes]], kinds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    parts = [chunks.unpack(b, "<u8", "u1") for k, b in told if k in kinds]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _ask_runs(n_buckets: int):
    def step(table: pa.Table, told: list) -> list[tuple[int, int, bytes]]:
        _, ids, buf, offsets = chunks.ordered(table)
        runs = Runs(buf, offsets)
        first = runs.first_at
        first = first[np.argsort(runs.digit[first], kind="stable")]
        digit, run, doc = runs.digit[first], runs.run[first], ids[runs.text[first]]
        # the digit is a least hash, hence not uniform: mixed before buckets are dealt
        home = (mix(digit.copy()) % np.uint64(n_buckets)).astype(np.int64)
        return [(b, RUNS, chunks.pack(chunks.deltas(digit[rows]), run[rows], doc[rows])) for b, rows in chunks.split_by(home, n_buckets)]

    return step


def _answer_runs(chunk_ids: list[int], kinds: list[int], packed: list[bytes]) -> list[tuple[int, int, bytes]]:
    parts = [chunks.unpack(b, "<u8", "<u8", "<i8") for b in packed]
    digit = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    run, doc = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    source = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    order = np.lexsort((doc, run, digit))
    digit, run, source = digit[order], run[order], source[order]
    new_digit = np.append(True, digit[1:] != digit[:-1])
    new_run = new_digit | np.append(True, run[1:] != run[:-1])
    # distinct runs of each digit
    group = np.cumsum(new_digit) - 1
    several = (np.bincount(group, weights=new_run) > 1)[group]
    flag = np.where(new_run, np.where(several, EDGE, 0), REPEATED).astype(np.uint8)
    told = np.flatnonzero(flag)
    out = []
    for s, rows in chunks.split_by(source[told], len(parts)):
        out.append((chunk_ids[s], RUNS, chunks.pack(run[told[rows]], flag[told[rows]])))
    return out


def _opened(runs: Runs, flag: np.ndarray) -> np.ndarray:
    return np.flatnonzero(runs.is_first & (flag != REPEATED) & ((flag == EDGE) | runs.twice))


def _ask_windows(n_buckets: int):
    def step(table: pa.Table, told: list) -> list[tuple[int, int, bytes]]:
        _, ids, buf, offsets = chunks.ordered(table)
        runs = Runs(buf, offsets)
        flag = _lookup(*_flags(told, (RUNS,)), runs.run)
        _, window, text = runs.windows(_opened(runs, flag))
        window, where = np.unique(window, return_index=True)
        doc = ids[text[where]]
        home = (window % np.uint64(n_buckets)).astype(np.int64)
        out = [(b, WINDOWS, chunks.pack(chunks.deltas(window[rows]), doc[rows])) for b, rows in chunks.split_by(home, n_buckets)]
        # what was told about runs is needed once more: it goes along
        here = int(table.column("chunk")[0].as_py()) % n_buckets
        return out + [(here, PASSED, b) for _, b in told]

    return step


def _answer_windows(chunk_ids: list[int], kinds: list[int], packed: list[bytes]) -> list[tuple[int, int, bytes]]:
    out = [(c, PASSED, b) for c, k, b in zip(chunk_ids, kinds, packed, strict=True) if k == PASSED]
    asked = [(c, chunks.unpack(b, "<u8", "<i8")) for c, k, b in zip(chunk_ids, kinds, packed, strict=True) if k == WINDOWS]
    if not asked:
        return out
    window = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for _, p in asked])
    doc = np.concatenate([p[1] for _, p in asked])
    source = np.repeat(np.arange(len(asked)), [len(p[1]) for _, p in asked])
    order = np.lexsort((doc, window))
    window, source = window[order], source[order]
    later = np.flatnonzero(np.append(False, window[1:] == window[:-1]))
    for s, rows in chunks.split_by(source[later], len(asked)):
        found = window[later[rows]]
        out.append((asked[s][0], WINDOWS, chunks.pack(found, np.full(len(found), REPEATED, np.uint8))))
    return out


def removed_bytes(buf: np.ndarray, offsets: np.ndarray, told: list[tuple[int, bytes]]) -> np.ndarray:
    """Which bytes of a chunk are covered by a repeated window."""
    runs = Runs(buf, offsets)
    flag = _lookup(*_flags(told, (PASSED,)), runs.run)
    gone = ~runs.is_first | (flag == REPEATED)
    at, window, _ = runs.windows(_opened(runs, flag))
    fresh = np.zeros(len(at), bool)
    fresh[np.unique(window, return_index=True)[1]] = True
    again = ~fresh | (_lookup(*_flags(told, (WINDOWS,)), window) == REPEATED)
    starts = np.concatenate([runs.low[gone], at[again]])
    ends = np.concatenate([runs.high[gone] + LENGTH, at[again] + LENGTH])
    return covered(len(buf), starts, ends)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False, chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """A row per document: ``doc_id, n_bytes, spans`` (removed, maximal) and ``kept`` (remaining bytes).

    With ``carry``, ``kept`` is text instead (bytes of a character cut in half are left out) and ``row`` holds the
    document's own columns.
    """
    parts, n_chunks = chunks.chunked(docs, doc_id, text, chunk_bytes, carry)
    n_buckets = max(1, n_chunks // 4)
    told = chunks.answer(chunks.ask(parts, None, _ask_runs(n_buckets)), _answer_runs)
    told = chunks.answer(chunks.ask(parts, told, _ask_windows(n_buckets)), _answer_windows)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType() if carry else T.BinaryType())]
    if carry:
        fields.append(parts.schema["row"])
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def last(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        table, _, buf, offsets = chunks.ordered(table)
        gone = removed_bytes(buf, offsets, answers)
        before = np.zeros(len(gone), bool)
        before[1:] = gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(gone)]
        before[inner] = False
        after = np.zeros(len(gone), bool)
        after[:-1] = gone[1:]
        after[inner[inner > 0] - 1] = False
        starts, ends = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        first = np.searchsorted(starts, offsets)
        base = np.repeat(offsets[:-1], np.diff(first))
        spans = pa.ListArray.from_arrays(
            pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"])
        )
        left = buf[~gone]
        cut = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(~gone, out=cut[1:])
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(cut[offsets].astype(np.int64)), pa.py_buffer(left.tobytes())])
        if carry:
            kept = pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())
        columns = [table.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), spans.cast(arrow.field("spans").type), kept.cast(arrow.field("kept").type)]
        if carry:
            columns.append(table.column("row").combine_chunks())
        return pa.Table.from_arrays(columns, names=schema.names)

    return chunks.finish(parts, told, schema, last)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated strings taken out of its texts; every row and column stays. A null text becomes empty."""
    made = deduplicate(docs, doc_id, text, carry=True)
    return made.select(*[made["kept"].alias(c) if c == text else made["row"][c].alias(c) for c in docs.columns])
