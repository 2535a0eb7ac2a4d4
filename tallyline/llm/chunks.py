"""Documents in chunks of bounded size, and questions that chunks ask about keys all chunks share.

Two steps alternate. A *chunk* step sees some documents whole, in (doc_id,
text) order, and sends its keys, already reduced to one row per key and chunk,
packed by bucket. A *bucket* step sees a share of the key space from all
chunks and answers each chunk. A key's hot group has at most one entry per
chunk, so no bucket holds a group of documents.

Texts are shuffled by chunk once: every chunk step of a plan groups the same
frame by the same column, so Spark reuses the exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import text_buffer

CHUNK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).min

ANSWERS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("packed", T.BinaryType())])
QUESTIONS = T.StructType([T.StructField("bucket", T.LongType()), *ANSWERS.fields])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, so that sorted or small values shrink."""
    n = len(arrays[0])
    planes = [np.int64(n).tobytes()]
    for a in arrays:
        planes.append(np.ascontiguousarray(a.reshape(n, 1).view(np.uint8).reshape(n, a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * size
    return out


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def chunked(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int, carry: bool = False) -> tuple[DataFrame, int]:
    """``(chunk, doc_id, text[, row])`` and the number of chunks; ``row`` holds all other columns if carried."""
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    n_chunks = max(1, -(-int(total) // chunk_bytes))
    chunk = F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(n_chunks)).alias("chunk")
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return docs.select(chunk, *columns), n_chunks


def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a chunk by (id, text), nulls first: table, ids, bytes and offsets."""
    table = table.combine_chunks()
    table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
    ids = table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
    buf, offsets = text_buffer(table.column("text"))
    return table, ids, buf, offsets


def ask(docs: DataFrame, answers: DataFrame | None, step: Callable[[pa.Table, list[tuple[int, bytes]]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """One chunk step: ``step(documents, answers so far)`` gives ``(bucket, kind, packed)``."""

    def run(docs_table: pa.Table, told: list[tuple[int, bytes]]) -> pa.Table:
        if not docs_table.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())], names=QUESTIONS.names)
        chunk = docs_table.column("chunk")[0].as_py()
        rows = step(docs_table, told)
        buckets, kinds, packed = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.Table.from_arrays(
            [pa.array(buckets, pa.int64()), pa.array([chunk] * len(buckets), pa.int64()), pa.array(kinds, pa.int32()), pa.array(packed, pa.binary())], names=QUESTIONS.names
        )

    if answers is None:
        return docs.groupBy("chunk").applyInArrow(lambda t: run(t, []), QUESTIONS)
    both = docs.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(lambda t, a: run(t, list(zip(a.column("kind").to_pylist(), a.column("packed").to_pylist(), strict=True))), QUESTIONS)


def answer(questions: DataFrame, step: Callable[[list[int], list[int], list[bytes]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """One bucket step: ``step(chunks, kinds, packed)`` gives ``(chunk, kind, packed)``."""

    def run(table: pa.Table) -> pa.Table:
        rows = step(table.column("chunk").to_pylist(), table.column("kind").to_pylist(), table.column("packed").to_pylist())
        chunks, kinds, packed = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.Table.from_arrays([pa.array(chunks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(packed, pa.binary())], names=ANSWERS.names)

    return questions.groupBy("bucket").applyInArrow(run, ANSWERS)


def finish(docs: DataFrame, answers: DataFrame, schema: T.StructType, step: Callable[[pa.Table, list[tuple[int, bytes]]], pa.Table]) -> DataFrame:
    """The last chunk step, which returns rows of ``schema``."""

    def run(docs_table: pa.Table, told: pa.Table) -> pa.Table:
        return step(docs_table, list(zip(told.column("kind").to_pylist(), told.column("packed").to_pylist(), strict=True)))

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def split_by(home: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """``(bucket, rows)`` for each bucket that occurs, rows in their order."""
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(n + 1))
    return [(b, order[cuts[b] : cuts[b + 1]]) for b in range(n) if cuts[b + 1] > cuts[b]]
