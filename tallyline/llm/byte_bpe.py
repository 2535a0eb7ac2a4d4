"""Byte-level BPE: every distinct word of the corpus is encoded once.

1. *Words and positions.* Texts are cut into pre-tokens by the public pattern.
   A task numbers the distinct pre-tokens of a block of text (up to
   ``BLOCK_BYTES``) and keeps each document as the list of those numbers, by
   position. Words and documents of the blocks come from two passes over the
   texts, because keeping the documents in between would store the corpus
   twice; both passes sign their blocks, and a block whose signatures differ
   (an input whose rows come in another order each time) raises an error.
2. *Distinct words.* The blocks' word lists are shuffled by word hash. A word is
   merged to ids once, whatever the number of blocks that have it; a word's
   group has a row per block, not per occurrence.
3. *Ids.* They go back to the blocks, and documents are put together by position.

Splitting is itself done on distinct strings: a space before a byte that is
surely no white space always begins a pre-token, and what follows it never
depends on what came before, so a slice is cut at such spaces with array
arithmetic and only its distinct parts go through the pattern.

Decoding joins ids with the token-byte table; the table is fixed (one row per
rank), so it is broadcast.

Null text is the empty text: no ids. Ids that are not in the table raise an
error. Repeated rows and null ids of documents are encoded each. An empty
table gives no rows. A very long text is a block of its own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import mix, ragged, span_hashes, text_slices
from .chunks import pack, split_by, unpack

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 12 << 20
_WORK = 1 << 20

DOCUMENT, WORDS, SIGNATURE = 0, 1, 2
BLOCKS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()),
    T.StructField("signature", T.LongType()), T.StructField("numbers", T.BinaryType()), T.StructField("words", T.BinaryType()),
])
REPLIES = T.StructType([T.StructField("block", T.LongType()), T.StructField("signature", T.LongType()), T.StructField("numbers", T.BinaryType()), T.StructField("ids", T.BinaryType())])
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
# no byte of UTF-8 text
_BETWEEN = b"\xff"

# bytes after a space that are surely not (the beginning of) white space
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE1] = True
_SOLID[0xE4:0xF5] = True


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def part_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts, and within them parts that are split independently, begin."""
    begin = np.zeros(len(buf), bool)
    if len(buf) > 1:
        begin[:-1] = (buf[:-1] == 0x20) & _SOLID[buf[1:]]
    # the last byte of a text may be a space whose next byte belongs to another text
    begin[offsets[1:][offsets[1:] > 0] - 1] = False
    begin[offsets[:-1][offsets[:-1] < len(buf)]] = True
    return np.flatnonzero(begin)


class Numbering:
    """Distinct pre-tokens of a block and their numbers, in order of appearance."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.number: dict[bytes, int] = {}

    def split(self, part: bytes) -> list[int]:
        number = self.number
        if part.isalpha() or (part[:1] == b" " and part[1:].isalpha()):
            return [number.setdefault(part, len(number))]
        return [number.setdefault(w.encode(), len(number)) for w in self.find(part.decode())]

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        starts = part_starts(buf, offsets)
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        _, where, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        # in order of appearance, so that frequent words get small numbers
        order = np.argsort(where)
        lists: list = [None] * len(where)
        for u, a, b in zip(order.tolist(), starts[where[order]].tolist(), ends[where[order]].tolist(), strict=True):
            lists[u] = self.split(raw[a:b])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((n for x in lists for n in x), np.uint32, int(sizes.sum()))
        at = np.cumsum(sizes) - sizes
        counts = sizes[back]
        numbers = flat[ragged(at[back], counts)] if len(back) else flat
        bound = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=bound[1:])
        cut = bound[np.searchsorted(starts, offsets)]
        return [numbers[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _blocks(pattern: str, n_buckets: int, wanted: int):
    """Rows of one kind: the blocks' words by bucket (``WORDS``), or their documents and signatures (``DOCUMENT``)."""

    def words_of(block: int, signature: int, numbering: Numbering) -> Iterator[tuple]:
        words = list(numbering.number)
        if not words:
            return
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        buf = np.frombuffer(b"".join(words), np.uint8)
        home = (mix(span_hashes(buf, ends - size, ends)) % np.uint64(n_buckets)).astype(np.int64)
        for bucket, mine in split_by(home, n_buckets):
            mine = np.array(sorted(mine.tolist(), key=words.__getitem__))
            yield block, WORDS, bucket, signature, pack(mine.astype(np.uint32)), _compress(_BETWEEN.join([words[i] for i in mine.tolist()]))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), kinds, strict=True)], names=BLOCKS.names)

    def closed(block: int, signature: int, numbering: Numbering) -> list[tuple]:
        if wanted == WORDS:
            return list(words_of(block, signature, numbering))
        return [(block, SIGNATURE, None, signature, None, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        numbering, held, signature = Numbering(pattern), 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, buf, offsets in text_slices(batch.column(1), _WORK):
                if held and held + len(buf) > BLOCK_BYTES:
                    if found := closed(block, signature, numbering):
                        yield batch_of(found)
                    block, numbering, held, signature = block + 1, Numbering(pattern), 0, 0
                held += len(buf)
                signature = zlib.crc32(buf, zlib.crc32(offsets, signature))
                documents = numbering.documents(buf, offsets)
                if wanted == DOCUMENT:
                    yield batch_of([(block, DOCUMENT, ids[i + r], None, pack(d), None) for r, d in enumerate(documents)])
        if found := closed(block, signature, numbering):
            yield batch_of(found)

    return run


def _compress(raw: bytes) -> bytes:
    return pack(np.frombuffer(raw, np.uint8))


def _encode_words(path: str):
    """Merge each distinct word of a bucket once and answer every block that has it."""

    def run(table: pa.Table) -> pa.Table:
        merge = _merger(path)
        known: dict[bytes, list[int]] = {}
        replies = []
        for blob in table.column("words").to_pylist():
            words = unpack(blob, "u1")[0].tobytes().split(_BETWEEN)
            for w in words:
                if w not in known:
                    known[w] = merge(w)
            lists = [known[w] for w in words]
            sizes = np.fromiter(map(len, lists), np.uint32, len(lists))
            flat = np.fromiter((t for x in lists for t in x), np.uint32, int(sizes.sum()))
            replies.append(_two(sizes, flat))
        return pa.Table.from_arrays([table.column("block"), table.column("signature"), table.column("numbers"), pa.chunked_array([pa.array(replies, pa.binary())])], names=REPLIES.names)

    return run


def _two(sizes: np.ndarray, flat: np.ndarray) -> bytes:
    first = pack(sizes)
    return len(first).to_bytes(8, "little") + first + pack(flat)


def _untwo(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    return unpack(blob[8 : 8 + n], "<u4")[0], unpack(blob[8 + n :], "<u4")[0]


_mergers: dict[str, object] = {}


def _merger(path: str):
    if path not in _mergers:
        encoding = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
        _mergers[path] = encoding._core_bpe.encode_single_piece
    return _mergers[path]


def _reassemble(docs: pa.Table, replies: pa.Table) -> pa.Table:
    """Documents of a block: word numbers replaced by the words' ids, in place."""
    kind = docs.column("kind").to_numpy()
    if not len(kind):
        return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], names=ENCODED.names)
    signed = set(docs.column("signature").drop_null().to_pylist())
    if len(signed) != 1 or not signed.issuperset(replies.column("signature").to_pylist()):
        raise ValueError("the input's rows came in another order when read again; write it before encoding")
    docs = docs.filter(pa.array(kind == DOCUMENT))
    lengths = np.zeros(docs.num_rows, np.int64)
    flats = []
    if replies.num_rows:
        numbers = np.concatenate([unpack(b, "<u4")[0] for b in replies.column("numbers").to_pylist()]).astype(np.int64)
        pairs = [_untwo(b) for b in replies.column("ids").to_pylist()]
        sizes = np.concatenate([p[0] for p in pairs]).astype(np.int64)
        flat = np.concatenate([p[1] for p in pairs])
        at, size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        at[numbers] = np.cumsum(sizes) - sizes
        size[numbers] = sizes
        for r, blob in enumerate(docs.column("numbers").to_pylist()):
            mine = unpack(blob, "<u4")[0]
            counts = size[mine]
            lengths[r] = counts.sum()
            flats.append(flat[ragged(at[mine], counts)])
    ids = np.concatenate([np.zeros(0, np.uint32), *flats]).view(np.int32)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
    return pa.Table.from_arrays([docs.column("key"), pa.chunked_array([made])], names=ENCODED.names)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row: ids of the whole text, without special tokens."""
    path = path or public_tokenizers.path(VOCABULARY)
    n_buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = slim.mapInArrow(_blocks(pattern, n_buckets, WORDS), BLOCKS)
    replies = words.groupBy("key").applyInArrow(_encode_words(path), REPLIES)
    documents = slim.mapInArrow(_blocks(pattern, n_buckets, DOCUMENT), BLOCKS).select("block", "kind", "key", "signature", "numbers")
    return documents.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_reassemble, ENCODED)


def token_table(spark: SparkSession, path: str | None = None):
    """The token-byte table by id, broadcast: a fixed number of rows."""
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    rows: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        rows[rank] = token
    return spark.sparkContext.broadcast(rows)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_le, decoded)``: the ids as little-endian bytes and the bytes they stand for."""
    table = token_table(encoded.sparkSession, path)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(table.value, pa.binary())
        for batch in batches:
            documents = batch.column(0).to_pylist()
            column = batch.column(1)
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            values = column.values
            for at in range(0, len(column), 256):
                end = min(len(column), at + 256)
                ids = values.slice(int(bounds[at]), int(bounds[end] - bounds[at])).to_numpy(zero_copy_only=False)
                cut = bounds[at : end + 1] - bounds[at]
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                text = []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    # join with the table: one gather per document
                    found = tokens.take(pa.array(ids[a:b]))
                    if found.null_count:
                        raise ValueError("an id is not in the token table")
                    text.append(b"".join(found.to_pylist()) if b - a < 8 else _joined(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(documents[at:end], pa.int64()), pa.array(np.diff(cut).astype(np.int64)), pa.array(raw, pa.binary()), pa.array(text, pa.binary())], names=schema.names
                )

    return encoded.mapInArrow(run, schema)


def _joined(found: pa.BinaryArray) -> bytes:
    bounds = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
    return found.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]]
