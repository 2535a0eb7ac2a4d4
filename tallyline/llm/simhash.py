"""SimHash near-duplicates by Golay-code fuzzy keys.

Fingerprints are cut into three segments of 21, 21 and 22 bits. The perfect
binary Golay code [23, 12, 7] has exactly one codeword within three bits of
any 23-bit word, so a segment (padded with zeros) decodes to a 12-bit index.
The *indices* of a segment are those of the segment itself and of every word
one bit away: one index, or six where the segment lies three bits from its
codeword. Two segments at most two bits apart share an index: a word halfway
between them decodes alike from both sides.

Pigeonhole for at most four differing bits over three segments: either one
segment is equal and another differs in at most two bits, or every segment
differs and none in more than two. Hence two kinds of keys:

* (exact segment, index of another segment): six ordered pairs of segments;
* (index, index, index) of all three.

Every pair within four bits shares a key. Rows with equal keys meet, and each
meeting is verified on the full fingerprints; what is linked goes to
connected components over fingerprints. A component's name is looked up
afterwards, so neither null nor repeated document ids play a part in it.

Fingerprints are made distinct first, so a group of identical texts is one
row. Inside a key no pairs are emitted for large groups, only the links of a
spanning forest, so the output stays linear in the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .arrays import mix
from .shared import components, free_name, with_computed

SHINGLE = 4
SEED = 42
MOST_BITS = 4
# keys that one reducing task holds at a time
BUCKET_KEYS = 1 << 21
# fingerprints that one task makes keys of
SPREAD = 1 << 14
# a group of equal keys up to this size is compared by shifting; larger ones in blocks
SHIFTED = 24
BLOCK = 1024

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes) -> int:
    """64 bits; a bit is set if it is set in over half the hashes of the shingles, repeats included."""
    parts = text.lower().split()  # bytes: only A-Z and only ASCII white space
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.zeros(n, np.int64)
    starts[1:] = ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    made = np.fromiter(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)],
        np.uint64, n - SHINGLE + 1,
    )
    rows = made.view(np.uint8).reshape(-1, 8)
    counts = np.bincount((rows + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts > len(made)).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(column: pa.Array) -> dict[str, object]:
    raw = column.cast(pa.large_binary()).to_pylist()
    return {"fp": np.fromiter([fingerprint(t or b"") for t in raw], np.uint64, len(raw)).view(np.int64)}


# ---- Golay code

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial."""
    rest = word.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _error_table() -> np.ndarray:
    """For each of the 2,048 remainders the one error pattern of at most three bits."""
    single = 1 << np.arange(23, dtype=np.int64)
    patterns = [np.zeros(1, np.int64), single]
    patterns.append(np.array([a | b for i, a in enumerate(single) for b in single[i + 1 :]]))
    patterns.append(np.array([a | b | c for i, a in enumerate(single) for j, b in enumerate(single[i + 1 :], i + 1) for c in single[j + 1 :]]))
    every = np.concatenate(patterns)
    table = np.full(2048, -1, np.int64)
    table[_syndrome(every)] = every
    return table


_tables: dict[str, np.ndarray] = {}


def decode(word: np.ndarray) -> np.ndarray:
    """The 12-bit index (upper bits) of the codeword nearest to each 23-bit word."""
    if not _tables:
        _tables["error"] = _error_table()
    return (word ^ _tables["error"][_syndrome(word)]) >> 11


def indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of each segment and its one-bit neighbours: ``(values, valid)`` of shape (n, 6)."""
    near = np.stack([decode(segment), *[decode(segment ^ (1 << b)) for b in range(23)]], axis=1)
    near.sort(axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    rank = np.cumsum(fresh, axis=1) - 1
    values, valid = np.zeros((len(segment), 6), np.int64), np.zeros((len(segment), 6), bool)
    row, col = np.nonzero(fresh)
    values[row, rank[row, col]] = near[row, col]
    valid[row, rank[row, col]] = True
    return values, valid


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, row)``: all keys of the unsigned fingerprints and the row each belongs to."""
    parts = [(fp & np.uint64(0x1FFFFF)), ((fp >> np.uint64(21)) & np.uint64(0x1FFFFF)), (fp >> np.uint64(42))]
    parts = [p.astype(np.int64) for p in parts]
    found = [indices(p) for p in parts]
    keys, rows = [], []
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            values, valid = found[j]
            key = (np.int64(i * 3 + j) << 40) | (parts[i][:, None] << 12) | values
            row, col = np.nonzero(valid)
            keys.append(key[row, col])
            rows.append(row)
    (v0, ok0), (v1, ok1), (v2, ok2) = found
    key = (np.int64(15) << 40) | (v0[:, :, None, None] << 24) | (v1[:, None, :, None] << 12) | v2[:, None, None, :]
    row, a, b, c = np.nonzero(ok0[:, :, None, None] & ok1[:, None, :, None] & ok2[:, None, None, :])
    keys.append(key[row, a, b, c])
    rows.append(row)
    return np.concatenate(keys).astype(np.uint64), np.concatenate(rows)


_PACKED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("packed", T.BinaryType())])
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _emit_keys(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                key, row = fuzzy_keys(fp)
                home = (mix(key) % np.uint64(n_buckets)).astype(np.int64)
                order = np.lexsort((key, home))
                key, row, home = key[order], row[order], home[order]
                cuts = np.flatnonzero(np.diff(home, prepend=-1))
                ends = np.append(cuts[1:], len(home))
                blobs = [zip_.compress(key[a:b].tobytes() + fp[row[a:b]].tobytes()) for a, b in zip(cuts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home[cuts]), pa.array((ends - cuts).astype(np.int32)), pa.array(blobs, pa.binary())], names=_PACKED.names
                )

    return run


def forest(fp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large group: each row to the smallest document of its component, compared in blocks."""
    order = np.argsort(doc, kind="stable")
    fp, doc = fp[order], doc[order]
    n = len(fp)
    root = np.arange(n)
    while True:
        least = root.copy()
        for i in range(0, n, BLOCK):
            for j in range(0, n, BLOCK):
                near = np.bitwise_count(fp[i : i + BLOCK, None] ^ fp[None, j : j + BLOCK]) <= MOST_BITS
                low = np.where(near, root[None, j : j + BLOCK], n).min(axis=1)
                np.minimum(least[i : i + BLOCK], low, out=least[i : i + BLOCK])
        while True:
            jump = least[least]
            if np.array_equal(jump, least):
                break
            least = jump
        if np.array_equal(least, root):
            break
        root = least
    moved = np.flatnonzero(root != np.arange(n))
    return doc[root[moved]], doc[moved]


def links_of(key: np.ndarray, fp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows with equal keys."""
    order = np.argsort(key, kind="stable")
    key, fp, doc = key[order], fp[order], doc[order]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cuts, len(key)))
    left, right = [], []
    group_size = np.repeat(sizes, sizes)
    small = group_size <= SHIFTED
    for shift in range(1, min(SHIFTED, int(sizes.max(initial=1)))):
        at = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
        near = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= MOST_BITS]
        left.append(doc[near])
        right.append(doc[near + shift])
    for g in np.flatnonzero(sizes > SHIFTED):
        a, b = forest(fp[cuts[g] : cuts[g] + sizes[g]], doc[cuts[g] : cuts[g] + sizes[g]])
        left.append(a)
        right.append(b)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.stack([np.concatenate(left), np.concatenate(right)], axis=1)
    pairs.sort(axis=1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _reduce(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint64).reshape(2, -1) for b in table.column("packed").to_pylist()]
    whole = np.concatenate(parts, axis=1)
    a, b = links_of(whole[0], whole[1], whole[1].view(np.int64))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` per row, ``fp`` signed. Null and blank texts have fingerprint 0, linked like any other."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made, names = with_computed(slim, ["text"], {"fp": T.LongType()}, _fingerprints)
    return made.select("doc_id", F.col(names["fp"]).alias("fp"))


def _named(prints: DataFrame) -> DataFrame:
    """``(_fp, _group, component_id)`` per distinct fingerprint: its component and the least document id in it."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct-fingerprints")
    n = distinct.count()
    n_buckets = max(1, -(-n * 190 // BUCKET_KEYS))
    # fingerprints are few bytes and their keys are many: they are spread by number, not by size
    spread = distinct.select("fp").repartition(-(-n // SPREAD) or 1, "fp")
    packed = spread.mapInArrow(_emit_keys(n_buckets), _PACKED)
    links = packed.groupBy("bucket").applyInArrow(_reduce, _LINKS)
    stars = components(links)
    members = distinct.join(stars, distinct["fp"] == stars["node"], "left").select(
        F.col("fp").alias("_fp"), "doc", F.coalesce("component", "fp").alias("_group")
    )
    members = materialise(members, "members")
    # written, so that the join below can split a large component
    names = materialise(members.groupBy(F.col("_group").alias("_named")).agg(F.min("doc").alias("component_id")), "component-names")
    return members.join(names, members["_group"] == names["_named"]).select("_fp", "_group", "component_id")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest document id reachable by links of at most
    four differing bits, the row's own included. Rows that repeat a document id
    each get a row; different texts under one id are not linked by it. A null
    document id is never a component's name; a component of such rows alone has
    a null one. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    named = _named(prints)
    return prints.join(named, prints["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the first by (``doc_id``, ``text``), nulls last.

    A row whose document id is null stays where its group has no other id, and
    different texts under one id stay where they are no near copies.
    """
    named = _named(materialise(fingerprints(docs, doc_id, text), "fingerprints"))
    made, names = with_computed(docs, [text], {"fp": T.LongType()}, _fingerprints)
    fp, group, first = names["fp"], free_name("_group", made.columns), free_name("_first", made.columns)
    row = free_name("_row", made.columns)
    named = named.select(F.col("_fp"), F.col("_group").alias(group), F.col("component_id").alias(first))
    # at most the rows that repeat the first id of a group are left to choose from
    firsts = made.join(named, (made[fp] == named["_fp"]) & made[doc_id].cast("long").eqNullSafe(named[first]))
    whole = F.struct(*[made[c] for c in docs.columns])
    order = F.struct(made[text].isNull(), made[text].cast("string"))
    return firsts.groupBy(group).agg(F.min_by(whole, order).alias(row)).select(f"{row}.*")
