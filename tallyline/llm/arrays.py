"""Byte-level text arithmetic for Arrow batches: words, their hashes, ragged gathers.

A column of texts is one byte buffer with offsets; the functions here work on
whole slices of it, so nothing runs per word in Python. Slices bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# bytes of text that are worked on at a time; a longer text is a slice of its own
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (multiply, fold, multiply, fold)."""
    h = h * _ODD[0]
    h ^= h >> np.uint64(32)
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    return h


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


# places whose values come from a table
_NEAR = 64


def _placed(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The value of a byte at a place of its span."""
    return mix(_BYTE_VALUE[byte] ^ ((place.astype(np.uint64) + np.uint64(1)) * _ODD[3]))


_PLACED = _placed(np.repeat(np.arange(_NEAR), 256), np.tile(np.arange(256), _NEAR))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and ``rows`` rows each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, i + rows)
        yield i, j
        i = j


def text_slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(i, j, bytes, offsets)`` of rows ``i`` to ``j``."""
    buf, offsets = text_buffer(column)
    for i, j in slices(offsets, most, rows):
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: their starts, their ends, and for each text (n + 1) the index of its first word."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[buf]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets >= 0) & (offsets < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand.

    Every (place in the span, byte) gives a value of its own, mixed so that none
    follows from another, and a span's values are summed: no algebra ties
    different strings together, as it does for polynomials modulo 2^64.
    """
    lengths = ends - starts
    total = int(lengths.sum())
    bound = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bound[1:])
    place = np.arange(total, dtype=np.int32 if total < 1 << 31 else np.int64)
    place -= np.repeat(bound[:-1].astype(place.dtype), lengths)
    # spans that cover the buffer without gaps need no gathering
    held = buf if total == len(buf) and (not total or (starts == bound[:-1]).all()) else buf[ragged(starts, lengths)]
    if not total or int(lengths.max()) <= _NEAR:
        value = _PLACED[(place << 8) | held]
    else:
        value = np.empty(total, np.uint64)
        near = place < _NEAR
        value[near] = _PLACED[(place[near] << 8) | held[near]]
        value[~near] = _placed(place[~near], held[~near])
    summed = np.zeros(total + 1, np.uint64)
    np.cumsum(value, out=summed[1:])
    return mix((summed[bound[1:]] - summed[bound[:-1]]) ^ (lengths.astype(np.uint64) * _ODD[2]))


def runs_of(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive values; n - length + 1 of them."""
    have, done, step = h, 1, 0
    tail, tail_length = None, 0
    rest = length
    while True:
        if rest & 1:
            if tail is None:
                tail, tail_length = have, done
            else:
                n = len(h) - tail_length - done + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                tail = mix(tail[:n] * _ODD[3] + have[tail_length : tail_length + n] * _ODD[4])
                tail_length += done
        rest >>= 1
        if not rest:
            return tail[: max(0, len(h) - length + 1)]
        n = max(0, len(have) - done)
        have = mix(have[:n] * _ODD[2] + have[done : done + n])
        done *= 2
        step += 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, … of every span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in at least one span."""
    delta = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int32)
    delta -= np.bincount(ends, minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(delta[:n]) > 0


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def string_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
