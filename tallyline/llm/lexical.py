"""Ranked lexical search: an Aho-Corasick scan of the documents for the terms of a query set.

Terms are the maximal runs of ASCII letters and digits and of characters beyond
ASCII; only A-Z are lower-cased. The terms of all items go into one automaton,
each guarded by a space on either side; a document's separators become spaces,
so the automaton reports exactly the whole terms, and its outputs, the term
numbers, lead to the items that hold the term. Documents are never indexed: a
first scan counts documents, terms and document frequencies, a second one
counts term frequencies again, scores, and keeps the best of each item.

Every task hands on at most ``k`` documents per item; these are cut again by
groups of tasks before they meet per item, so no item gathers more than a
bounded number of rows. Items come in blocks of bounded size (``BLOCK_ITEMS``,
``BLOCK_BYTES`` of terms, but one item at least), one automaton and two scans
each: what goes to the tasks is bounded, and every document is held against
every item.

The score of a document for an item, with N documents that have a term, L terms
in them, n in this one, df documents with the term and tf in this one:
``m = 50 + 50 n N / L``, ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, and the sum
over the item's terms of ``w * (10^9 tf / (1000 tf + 20 m))``, integers, divisions
rounding down.

Null texts have no terms. Rows of documents are documents, also where ids repeat
or are null (null ids rank last among equal scores); rows of items with the same
id, null included, are one item with the terms of all. Items without a term or
without a document of positive score have no rows; empty tables give none. Ids
are integers. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import per_text, ragged, text_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# bounds of one automaton
BLOCK_ITEMS, BLOCK_BYTES = 1024, 4 << 20
# documents scored at once, and groups of tasks whose candidates are cut before they meet
DOCS, GROUPS = 256, 64

_SPACE = 0x20
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else _SPACE for b in range(256)
)


class Block:
    """Some items and their terms, as sent to the tasks."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.items = [i for i, _ in items]
        self.terms = sorted({t for _, of in items for t in of})
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], i) for i, (_, of) in enumerate(items) for t in set(of))
        self.holders = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        return _automaton(tuple(self.terms))


@functools.lru_cache(maxsize=1)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Bytes are matched as characters of the same number, so that one map serves all scripts."""
    made = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        made.add_word(" " + term.encode().decode("latin-1") + " ", i)
    made.make_automaton()
    return made


def scan(column: pa.Array, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, list[int], list[dict[int, int]]]]:
    """``(first row, terms per document, frequency of found terms per document)`` for slices of a text column."""
    number = operator.itemgetter(1)
    for i, _, buf, offsets in text_slices(column, rows=DOCS):
        flat = buf.tobytes().translate(_BYTES)
        inside = np.frombuffer(flat, np.uint8) != _SPACE
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(flat)]
        start[heads] = inside[heads]
        counts = per_text(start, offsets).tolist()
        text = flat.decode("latin-1")
        found = [
            Counter(map(number, automaton.iter(f" {text[a:b]} "))) if n else {} for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), counts, strict=True)
        ]
        yield i, counts, found


def statistics(docs: DataFrame, block: Block, text: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all of them, and for each term of the block the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, df, with_terms, terms = block.automaton(), np.zeros(len(block.terms), np.int64), 0, 0
        for batch in batches:
            for _, counts, found in scan(batch.column(0), automaton):
                with_terms += sum(n > 0 for n in counts)
                terms += sum(counts)
                held = np.fromiter((t for f in found for t in f), np.int64)
                df += np.bincount(held, minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[with_terms, terms], df[at]]).astype(np.int64))], names=["term", "n"]
        )

    made = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term long, n long")
    total = {r["term"]: r["n"] for r in made.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most the block's terms and two
    df = np.array([total.get(i, 0) for i in range(len(block.terms))], np.int64)
    return total.get(-1, 0), total.get(-2, 0), df


class Best:
    """The ``k`` best documents of each item so far: highest score, then least id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.pending, self.room = 0, 4 * k * items + 65_536

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """``scores``: a row per document, a column per item."""
        doc, item = np.nonzero(scores >= self.least)
        self.rows.append((item, scores[doc, item], null[doc], ids[doc]))
        self.pending += len(doc)
        if self.pending > self.room:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, score, null, ids = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[place < self.k], item[place < self.k]
        last = place[place < self.k] == self.k - 1
        self.least[item[last]] = score[order[last]]
        self.rows = [(item, score[order], null[order], ids[order])]
        self.pending = len(item)
        return self.rows[0]


def best_of_block(docs: DataFrame, block: Block, k: int, id_column: str = "doc_id", text: str = "text") -> DataFrame | None:
    """``(item_id, doc_id, score)``: a superset of each item's ``k`` best documents, at most ``k`` per task."""
    n_docs, n_terms, df = statistics(docs, block, text)
    if not n_terms:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, best = block.automaton(), Best(len(block.items), k)
        width = np.diff(block.first)
        for batch in batches:
            ids = batch.column(0)
            null, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
            for i, counts, found in scan(batch.column(1), automaton):
                doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
                term = np.fromiter((t for f in found for t in f), np.int64, len(doc))
                tf = np.fromiter((n for f in found for n in f.values()), np.int64, len(doc))
                # exact at any size: Python integers
                m = np.array([50 + 50 * n * n_docs // n_terms for n in counts], np.int64)
                part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                scores = np.zeros(len(found) * len(block.items), np.int64)
                holder = block.holders[ragged(block.first[term], width[term])]
                np.add.at(scores, np.repeat(doc, width[term]) * len(block.items) + holder, np.repeat(part, width[term]))
                rows = slice(i, i + len(found))
                best.add(scores.reshape(len(found), -1), ids[rows], null[rows])
        if best.rows:
            item, score, null, ids = best.cut()
            names = pa.array(block.items, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(item)), pa.array(ids, pa.int64(), mask=null), pa.array(score)], names=["item_id", "doc_id", "score"]
            )

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "item_id long, doc_id long, score long")


def blocks_of(items: DataFrame, id_column: str = "item_id", text: str = "text", most: int | None = None) -> Iterator[Block]:
    """The items' distinct terms, in blocks; the driver holds one block at a time."""
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    terms = items.select(F.col(id_column).cast("long").alias("item"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    held: list[tuple[int | None, list[str]]] = []
    size = 0
    for row in terms.orderBy("item", "term").toLocalIterator():
        if not held or held[-1][0] != row["item"]:
            if held and (len(held) >= (most or BLOCK_ITEMS) or size > BLOCK_BYTES):
                yield Block(held)
                held, size = [], 0
            held.append((row["item"], []))
        held[-1][1].append(row["term"])
        size += len(row["term"].encode())
    if held:
        yield Block(held)


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text", most_items: int | None = None
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, equal scores by ascending id."""
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks_of(items, item_column, text, most_items):
        part = best_of_block(docs, block, k, id_column, text)
        found = found if part is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    groups = found.withColumn("_group", F.spark_partition_id() % GROUPS)
    cut = groups.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_group").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
