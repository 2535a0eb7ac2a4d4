"""Best-fit decreasing packing of documents into sequences of bounded length.

Every document becomes token ids plus an end mark; only documents longer than
a sequence are cut. Best-fit decreasing puts pieces, longest first, into the
open sequence with the least room that still fits. Pieces of equal length are
interchangeable, so the plan is made on the *histogram* of lengths: at most
``capacity`` counts, whatever the size of the corpus. Open sequences with the
same room and the same contents are one class with a count; a segment tree
over remaining capacities finds the tightest room that fits in logarithmic
time. The plan says, for each length, which ranks go to which sequences; it
has a few segments per length and does not grow with the data.

Ranks within a length are numbered in parallel: hashed shards number their own
rows, and a small sum over (length, shard) counts gives each shard its start.

Text is tokenised slice by slice. Distinct space-delimited words of a slice
are found by hashing, encoded once each, and gathered back by position; the ids
of words met lately are kept from slice to slice, in a bounded table. With
``added_tokens`` (as the registered query and the pipeline ask for) the added
tokens of the vocabulary file stand for themselves in a text, as they do in the
library by default; without, their letters are text like any other.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ..session import materialise
from .arrays import ragged, span_hashes, text_slices, words

CAPACITY = 2048
END = 0
VOCABULARY = "word_bpe_49k.json"
# words whose ids a worker keeps
KEPT_WORDS = 250_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


# ---- tokens


class WordTable:
    """Ids of words met in earlier slices, as flat arrays in the order of the words' hashes: some forty bytes a word.

    A word is found by its hash and then compared byte by byte. A table that would
    hold more than ``KEPT_WORDS`` keeps the words of the slice at hand alone, so it
    is bounded by the greater of both, and what it forgets is encoded again.
    """

    def __init__(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.word_at, self.word_size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids_at, self.ids_size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.letters, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def _met(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word: is its hash in the table, and is the word."""
        if not len(self.hash):
            return np.zeros(len(h), bool), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hashed = self.hash[at] == h
        same = hashed & (self.word_size[at] == size)
        some = np.flatnonzero(same)
        differ = buf[ragged(starts[some], size[some])] != self.letters[ragged(self.word_at[at[some]], size[some])]
        same[np.repeat(some, size[some])[differ]] = False
        return hashed, same

    def _keep(self, at: np.ndarray) -> None:
        """Forget all words but those at the given places."""
        self.hash = self.hash[at]
        for pool, place, size in (("letters", "word_at", "word_size"), ("ids", "ids_at", "ids_size")):
            starts, sizes = getattr(self, place)[at], getattr(self, size)[at].astype(np.int64)
            setattr(self, pool, getattr(self, pool)[ragged(starts, sizes)])
            setattr(self, place, np.cumsum(sizes) - sizes)
            setattr(self, size, getattr(self, size)[at])

    def places(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[bytes]], list[list[int]]]) -> np.ndarray:
        """Where the words, distinct and by rising hash, stand in the table; those not met yet are encoded and added."""
        size = ends - starts
        hashed, same = self._met(h, buf, starts, size)
        if (hashed & ~same).any():
            self.__init__()
            same[:] = False
        elif len(self.hash) + int((~same).sum()) > KEPT_WORDS:
            self._keep(np.searchsorted(self.hash, h[same]))
        new = ~same
        raw = buf.tobytes()
        words = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        lists = encode(words)
        size, count = size[new].astype(np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
        place = np.searchsorted(self.hash, h[new])
        for name, values in (
            ("hash", h[new]), ("word_at", len(self.letters) + np.cumsum(size) - size), ("word_size", size), ("ids_at", len(self.ids) + np.cumsum(count) - count), ("ids_size", count),
        ):
            setattr(self, name, np.insert(getattr(self, name), place, values))
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(words), np.uint8)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.uint32, int(count.sum()))])
        return np.searchsorted(self.hash, h)


class WordEncoder:
    """Ids of space-delimited words, as the vocabulary file's own library gives them.

    The file's rules never look across white space, so a text's ids are those
    of its words one after another. Words of plain ASCII letters, digits and
    punctuation are split by the file's pattern and merged by rank, with a byte
    that no text holds standing for the end-of-word mark; all other words go to
    the library. Tests hold both against the library on whole texts.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.path = path
        self.unmodified: Tokenizer | None = None
        self.added = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.merger = self._merger(vocabulary)
        # the pattern of the file, for lower-case ASCII
        self.split = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        self.plain = re.compile(rb"[!-~]+")
        self.known = WordTable()

    def holds_added(self, column: pa.Array) -> list[bool]:
        """Which texts hold an added token, be it inside a word."""
        if not self.added:
            return [False] * len(column)
        return pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), self.added), False).to_pylist()

    def encode_whole(self, text: str) -> np.ndarray:
        """Ids of a text by the library as it is, added tokens included."""
        if self.unmodified is None:
            self.unmodified = Tokenizer.from_file(self.path)
        return np.array(self.unmodified.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _merger(vocabulary: dict[str, int]) -> tiktoken.Encoding:
        """Ranks over bytes: printable stand-ins of the file turned back into bytes, the end mark into 0xFF."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            ends = token.endswith("</w>")
            body = token[:-4] if ends else token
            if i < len(vocabulary) - 2 and all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + b"\xff" * ends] = i
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_whole_bytes(ranks), special_tokens={})

    def encode(self, batch: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(batch)
        merge = self.merger._core_bpe.encode_single_piece
        rest = []
        for i, word in enumerate(batch):
            if word.isalpha():
                out[i] = merge(word.lower() + b"\xff")
            elif self.plain.fullmatch(word):
                out[i] = [t for part in self.split.findall(word.lower()) for t in merge(part + b"\xff")]
            else:
                rest.append(i)
        if rest:
            made = self.library.encode_batch([batch[i].decode() for i in rest], add_special_tokens=False)
            for i, e in zip(rest, made, strict=True):
                out[i] = e.ids
        return out


def _whole_bytes(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """All single bytes must have ranks; those the file lacks (the mark alone) get unused numbers."""
    free = iter(range(1 << 20, (1 << 20) + 256))
    return {bytes([b]): ranks.get(bytes([b]), None) if bytes([b]) in ranks else next(free) for b in range(256)} | ranks


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_ids(column: pa.Array, path: str, added_tokens: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, ids)`` of each text, without an end mark; null is empty. ``added_tokens``: see the module."""
    made = encoder(path)
    whole = made.holds_added(column) if added_tokens else [False] * len(column)
    for i, _, buf, offsets in text_slices(column):
        starts, ends, first = words(buf, offsets)
        h, where, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        table = made.known
        at = table.places(h, buf, starts[where], ends[where], made.encode)
        counts = table.ids_size[at].astype(np.int64)[back]
        ids = table.ids[ragged(table.ids_at[at][back], counts)]
        bound = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=bound[1:])
        cut = bound[first]
        for r in range(len(offsets) - 1):
            yield i + r, made.encode_whole(column[i + r].as_py()) if whole[i + r] else ids[cut[r] : cut[r + 1]]


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", added_tokens: bool = False
) -> DataFrame:
    """One row per piece: ids plus end mark, cut only if longer than ``capacity``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for r, ids in token_ids(batch.column(1), path, added_tokens):
                whole = np.append(ids, np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    rows.append((ids_of[r], k, at, len(part), zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=PIECES.names,
                )
        # a worker serves other tasks too
        encoder(path).known = WordTable()

    return slim.mapInArrow(run, PIECES)


# ---- plan


class Rooms:
    """A segment tree over remaining capacities: how many open classes have each room; the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        at = self.leaves + room
        while at:
            self.tree[at] += change
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that an open class has."""
        at = self.leaves + least
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns segments ``(length, first rank, ranks, first sequence, pieces per
    sequence, offset)``: rank ``first + i`` is piece ``i % per`` of sequence
    ``first sequence + i // per`` and starts at ``offset + (i % per) * length``.
    """
    rooms = Rooms(capacity)
    open_at: dict[int, list[list[int]]] = {}  # room -> classes [first sequence, sequences]
    plan = []
    made = 0

    def opened(room: int, first: int, n: int) -> None:
        if room > 0 and n:
            open_at.setdefault(room, []).append([first, n])
            rooms.add(room, 1)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                # new sequences: each takes as many as fit, since the fullest open one is always the tightest
                per = capacity // length
                n = left // per if left >= per else 0
                if n:
                    first, room = made, capacity
                    made += n
                else:
                    per, n, first, room = left, 1, made, capacity
                    made += 1
                plan.append((length, rank, n * per, first, per, 0))
                opened(room - per * length, first, n)
            else:
                first, there = open_at[room][-1]
                per = room // length
                n = min(there, left // per)
                if not n:
                    per, n = left, 1
                plan.append((length, rank, n * per, first, per, capacity - room))
                open_at[room].pop()
                rooms.add(room, -1)
                opened(room, first + n, there - n)
                opened(room - per * length, first, n)
            rank += n * per
            left -= n * per
    return plan


def pack(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", added_tokens: bool = False
) -> DataFrame:
    """Pieces with the sequence and the offset each is packed at.

    Null text is an empty document: one piece holding the end mark. Repeated
    rows are packed each. An empty table gives no rows. Which piece of equal
    length goes to which sequence is fixed by (shard, doc_id, piece).
    """
    cut = materialise(pieces(docs, capacity, vocabulary, doc_id, text, added_tokens), "pieces")
    n_shards = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_shards)).cast("int"))
    counts = sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most `capacity` rows reach the driver
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(best_fit(histogram, capacity), np.int64).reshape(-1, 6)
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        sharded.withColumn("nth", F.row_number().over(inside) - 1)
        .join(starts, ["length", "shard"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    )
    # the plan is sorted by length downwards and rank upwards: one search finds a piece's segment
    order = (capacity - plan[:, 0]) << 44 | plan[:, 1] if len(plan) else np.zeros(0, np.int64)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            row = plan[np.searchsorted(order, (capacity - length) << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            frame = frame.drop(columns="rank")
            frame["sequence_id"] = row[:, 3] + nth // row[:, 4]
            frame["offset"] = row[:, 5] + (nth % row[:, 4]) * length
            yield frame

    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInPandas(place, schema)
