"""Removal of repeated word passages by fixed-block anchors.

Every document is a reference: its non-overlapping blocks of ``BLOCK`` words
are indexed. Every document is also probed: each rolling window of ``BLOCK``
words is looked up among the blocks. Any ``LENGTH`` consecutive words hold a
whole block of the document they first stood in (``LENGTH >= 2 * BLOCK - 1``),
so every repeat is hit.

A hit is extended to the words around it: the windows of ``LENGTH`` words that
hold a hit are compared whole, each against the first document that has it;
neighbouring windows found that way make up the maximal exact repeats. Which
copy came first is decided per window, so a passage shared by any number of
documents costs a row per chunk and window, never a row per pair.

A word is removed if a window over it also starts in a document with a smaller
id, judged on the input. Probes are 48-bit hashes (a false hit only opens
windows that then differ); windows are compared by 64 bits of two independent
halves.

Null text has no words. Rows that repeat an id are not each other's
originals. A null id is smaller than all others. An empty table gives no rows.
Very long texts are whole in one chunk; nothing is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import chunks
from .arrays import covered, mix, per_text, ragged, runs_of, slices, span_hashes, words

LENGTH = 50
BLOCK = 25
_WORK = 1 << 20
_SHIFT = np.uint64(16)

PROBES, WINDOWS, LIVE = 1, 2, 3


class Words:
    """Words of a chunk's documents in order, with hashes of all runs of ``BLOCK`` words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        starts, ends, firsts, hashes = [], [], [np.zeros(1, np.int64)], []
        done = 0
        for i, j in slices(offsets, _WORK):
            part = buf[offsets[i] : offsets[j]]
            a, b, first = words(part, offsets[i : j + 1] - offsets[i])
            starts.append(a + offsets[i])
            ends.append(b + offsets[i])
            hashes.append(span_hashes(part, a, b))
            firsts.append(first[1:] + done)
            done += len(a)
        none = np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.first = np.concatenate(firsts)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        rolled = runs_of(np.concatenate([np.zeros(0, np.uint64), *hashes]), BLOCK)
        # runs that end in the document they start in
        self.at = np.flatnonzero(self.text[: len(rolled)] == self.text[BLOCK - 1 :]) if len(rolled) else none
        self.rolled = rolled
        self.run = rolled[self.at]

    def blocks(self) -> np.ndarray:
        """Which runs are blocks of their document."""
        return (self.at - self.first[self.text[self.at]]) % BLOCK == 0

    def opened(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that hold a hit."""
        if not len(live) or not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found = self.run >> _SHIFT
        hit = np.zeros(len(self.starts) + 1, np.int64)
        hit[self.at + 1] = live[np.minimum(np.searchsorted(live, found), len(live) - 1)] == found
        total = np.cumsum(hit)
        window = np.flatnonzero(self.text[: max(0, len(self.text) - LENGTH + 1)] == self.text[LENGTH - 1 :])
        # a window holds the runs that start in its first LENGTH - BLOCK + 1 words
        window = window[total[window + LENGTH - BLOCK + 1] > total[window]]
        return window, mix(self.rolled[window] * np.uint64(0x9E3779B97F4A7C15) + self.rolled[window + LENGTH - BLOCK])


def _ask_probes(n_buckets: int):
    def step(table: pa.Table, told: list) -> list[tuple[int, int, bytes]]:
        _, ids, buf, offsets = chunks.ordered(table)
        w = Words(buf, offsets)
        probe = w.run >> _SHIFT
        order = np.argsort(probe, kind="stable")
        probe, doc, block = probe[order], ids[w.text[w.at[order]]], w.blocks()[order]
        cut = np.flatnonzero(np.append(True, probe[1:] != probe[:-1])) if len(probe) else np.zeros(0, np.int64)
        if not len(cut):
            return []
        several = np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)
        indexed = np.logical_or.reduceat(block, cut)
        probe = probe[cut]
        mark = several.astype(np.uint8) | (indexed.astype(np.uint8) << 1)
        home = (probe * np.uint64(n_buckets)) >> np.uint64(48) if n_buckets < 1 << 15 else probe % np.uint64(n_buckets)
        return [(b, PROBES, chunks.pack(chunks.deltas(probe[rows]), mark[rows])) for b, rows in chunks.split_by(home.astype(np.int64), n_buckets)]

    return step


def _answer_probes(chunk_ids: list[int], kinds: list[int], packed: list[bytes]) -> list[tuple[int, int, bytes]]:
    parts = [chunks.unpack(b, "<u8", "u1") for b in packed]
    parts = [(np.cumsum(d, dtype=np.uint64), m) for d, m in parts]
    every = np.concatenate([p for p, _ in parts])
    mark = np.concatenate([m for _, m in parts])
    indexed = np.unique(every[(mark & 2) > 0])
    several = every[(mark & 1) > 0]
    every.sort()
    again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], several]))
    live = np.intersect1d(again, indexed, assume_unique=True)
    if not len(live):
        return []
    out = []
    for c, (probe, _) in zip(chunk_ids, parts, strict=True):
        at = np.minimum(np.searchsorted(probe, live), len(probe) - 1)
        mine = live[probe[at] == live]
        if len(mine):
            out.append((c, LIVE, chunks.pack(chunks.deltas(mine))))
    return out


def _live(told: list[tuple[int, bytes]]) -> np.ndarray:
    parts = [np.cumsum(chunks.unpack(b, "<u8")[0], dtype=np.uint64) for k, b in told if k == LIVE]
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *parts]))


def _firsts(w: Words, ids: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the index of each in the distinct hashes, those hashes and their smallest ids in this chunk."""
    at, window = w.opened(live)
    distinct, where, back = np.unique(window, return_index=True, return_inverse=True)
    return at, back, distinct, ids[w.text[at[where]]]


def _ask_windows(n_buckets: int):
    def step(table: pa.Table, told: list) -> list[tuple[int, int, bytes]]:
        _, ids, buf, offsets = chunks.ordered(table)
        _, _, window, doc = _firsts(Words(buf, offsets), ids, _live(told))
        home = (window % np.uint64(n_buckets)).astype(np.int64)
        out = [(b, WINDOWS, chunks.pack(chunks.deltas(window[rows]), doc[rows])) for b, rows in chunks.split_by(home, n_buckets)]
        # the live probes are needed once more: they go along
        here = int(table.column("chunk")[0].as_py()) % n_buckets
        return out + [(here, LIVE, b) for _, b in told]

    return step


def _answer_windows(chunk_ids: list[int], kinds: list[int], packed: list[bytes]) -> list[tuple[int, int, bytes]]:
    out = [(c, LIVE, b) for c, k, b in zip(chunk_ids, kinds, packed, strict=True) if k == LIVE]
    asked = [(c, chunks.unpack(b, "<u8", "<i8")) for c, k, b in zip(chunk_ids, kinds, packed, strict=True) if k == WINDOWS]
    if not asked:
        return out
    window = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for _, p in asked])
    doc = np.concatenate([p[1] for _, p in asked])
    source = np.repeat(np.arange(len(asked)), [len(p[1]) for _, p in asked])
    order = np.lexsort((doc, window))
    window, doc, source = window[order], doc[order], source[order]
    fresh = np.append(True, window[1:] != window[:-1])
    least = doc[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    later = np.flatnonzero(~fresh)
    for s, rows in chunks.split_by(source[later], len(asked)):
        at = later[rows]
        out.append((asked[s][0], WINDOWS, chunks.pack(window[at], least[at])))
    return out


def removed_words(w: Words, ids: np.ndarray, told: list[tuple[int, bytes]]) -> np.ndarray:
    """Which words of a chunk are covered by a window that starts in an earlier document."""
    at, back, window, least = _firsts(w, ids, _live(told))
    parts = [chunks.unpack(b, "<u8", "<i8") for k, b in told if k == WINDOWS]
    if parts and len(window):
        far, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        place = np.searchsorted(window, far)
        least[place] = np.minimum(least[place], doc)
    repeated = at[least[back] < ids[w.text[at]]]
    return covered(len(w.starts), repeated, repeated + LENGTH)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """A row per document: ``doc_id, n_words, n_removed, kept`` (kept words joined by one space)."""
    parts, n_chunks = chunks.chunked(docs, doc_id, text, chunk_bytes)
    n_buckets = max(1, n_chunks // 4)
    told = chunks.answer(chunks.ask(parts, None, _ask_probes(n_buckets)), _answer_probes)
    told = chunks.answer(chunks.ask(parts, told, _ask_windows(n_buckets)), _answer_windows)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(schema)

    def last(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        table, ids, buf, offsets = chunks.ordered(table)
        w = Words(buf, offsets)
        gone = removed_words(w, ids, answers)
        counts = np.diff(w.first)
        left = np.flatnonzero(~gone)
        # each kept word with the byte behind it, which becomes a space; the last one of a document is left out
        lengths = w.ends[left] - w.starts[left] + 1
        text_of = w.text[left]
        final = np.append(text_of[1:] != text_of[:-1], True)[: len(text_of)]
        stops = np.cumsum(lengths)
        flat = np.append(buf, np.uint8(0x20))[ragged(w.starts[left], lengths)]
        flat[stops - 1] = 0x20
        keep = np.ones(len(flat), bool)
        keep[stops[final] - 1] = False
        size = np.bincount(text_of, weights=lengths - final, minlength=len(counts)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        kept = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends), pa.py_buffer(flat[keep].tobytes()))
        return pa.Table.from_arrays(
            [table.column("doc_id").combine_chunks(), pa.array(counts), pa.array(per_text(gone, w.first)), kept.cast(pa.string())], names=schema.names
        )

    return chunks.finish(parts, told, schema, last)
