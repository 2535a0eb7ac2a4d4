"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space.

Terms of a text are hashed shapes, not words: trigrams of 16 byte classes
(lower case, capitals, digits, bars, symbols, …) and binned shares of repeated
words and windows. Their log counts, weighted by inverse document frequency,
are projected on the leading directions of the labelled sample's
term-document matrix.

The labelled sample is bounded: at most ``PER_LABEL`` rows of each label value,
chosen by hash of the id. Its vectors (``2 * PER_LABEL`` by ``RANK`` numbers)
are broadcast; every text of the corpus is compared with all of them, exactly,
one matrix product per block. The ``NEIGHBOURS`` nearest vote with weight
``cosine ** POWER``, times the labelled rows that each of them stands for (rows
of its label value by rows of it in the sample), so that a score means the same
whatever the size of the table.

Null and empty texts have no terms; their latent vector is zero and they get
label 1's share of the labelled rows. Ties at the last neighbour are broken by
the order of the sample. Repeated rows are scored each, equal texts alike. An
id labelled both 0 and 1 is not learned; of several texts under one id the
least by its terms is. Without any labelled row every score is 0.5. Very long
texts are one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_rules
from .arrays import per_text, span_hashes, text_slices, words
from .shared import with_computed

PER_LABEL = 1024
RANK = 48
NEIGHBOURS = 15
POWER = 8
THRESHOLD = 0.7
SHAPES = 4096
BINS = 16
TERMS = SHAPES + 2 * BINS
# texts whose dense term counts are held at a time
ROWS = 256
# a label value may hold most rows: its sample is drawn from shares first
SHARES = 64

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(
    ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "|", "#*$%&", "<>", "'\"()[]{}", "-_/\\:;=+@~^`"), 1
):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 15

FIELDS = {"score": T.DoubleType(), "predicted": T.IntegerType()}


def held_out(doc_id: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def term_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of terms, a row per text."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    kinds = _CLASS[buf]
    if len(buf) > 2:
        text_of = np.repeat(np.arange(n), np.diff(offsets))
        at = np.flatnonzero(text_of[:-2] == text_of[2:])
        code = text_of[at] * SHAPES + (kinds[at] * 256 + kinds[at + 1] * 16 + kinds[at + 2])
        out[:, :SHAPES] = np.bincount(code, minlength=n * SHAPES).reshape(n, SHAPES)
    starts, ends, first = words(buf, offsets)
    counts = np.diff(first)
    h = span_hashes(buf, starts, ends)
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = h[1:] == h[:-1]
        again[first[:-1][counts > 0]] = False
    windows = quality_rules._measure(buf, offsets)["n_repeat_words"]
    row = np.flatnonzero(counts)
    for k, share in enumerate((per_text(again, first), windows)):
        bin_ = np.minimum(BINS - 1, (share[row] * BINS) // np.maximum(1, counts[row]))
        # binned shares weigh as much as a term that fills a tenth of the text
        out[row, SHAPES + k * BINS + bin_] = 1 + (offsets[1:] - offsets[:-1])[row] * 0.1
    return out


@dataclass
class Model:
    """``columns`` of the counts, their ``idf``, ``directions``; latent ``vectors`` of the sample with their ``labels`` and the rows each stands for."""

    columns: np.ndarray
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = _unit(np.log1p(counts[:, self.columns]) * self.idf)
        return _unit(x @ self.directions)

    def score(self, counts: np.ndarray) -> np.ndarray:
        near = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        above, tied = near > least, near == least
        # of equal ones at the last place the first in the sample's order
        taken = above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
        best = np.nonzero(taken)[1].reshape(-1, k)
        weight = np.clip(np.take_along_axis(near, best, axis=1), 0, 1).astype(float) ** POWER * self.stands_for[best]
        total = weight.sum(axis=1)
        votes = (weight * self.labels[best]).sum(axis=1)
        return np.where(total > 1e-12, votes / np.maximum(total, 1e-12), np.average(self.labels, weights=self.stands_for))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_model(counts: np.ndarray, labels: np.ndarray, rows: dict[int, float] | None = None) -> Model | None:
    """Latent space and vectors of a sample; None for an empty one. ``rows``: labelled rows there are of each label value."""
    if not len(labels):
        return None
    present = (counts > 0).sum(axis=0)
    columns = np.flatnonzero(present >= min(3, len(labels)))
    if not len(columns):
        columns = np.arange(counts.shape[1])
    idf = np.log((1 + len(labels)) / (1 + present[columns])) + 0.5
    x = _unit(np.log1p(counts[:, columns]) * idf)
    values, vectors = np.linalg.eigh(x.T @ x)
    directions = vectors[:, np.argsort(-values)[:RANK]]
    stands_for = np.ones(len(labels))
    for label, n in (rows or {}).items():
        stands_for[labels == label] = n / max(1, (labels == label).sum())
    model = Model(columns, idf.astype(np.float32), directions.astype(np.float32), np.zeros((0, 0)), labels.astype(float), stands_for)
    model.vectors = model.latent(counts).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> Model | None:
    """Fit on at most ``per_label`` labelled rows of each value (0 and 1) that are not held out."""
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id"))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).filter("_label = _most").select("_id", "_label")
    order = (F.xxhash64("_id"), F.col("_id"))
    share = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(SHARES))
    chosen = known.withColumn("_share", share)
    for keys in (["_label", "_share"], ["_label"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        chosen = chosen.withColumn("_nth", nth).filter(F.col("_nth") <= per_label)
    chosen = chosen.select("_id", "_label")
    slim = docs.select(F.col(doc_id).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    # at most 2 * per_label rows are broadcast
    sample = slim.join(F.broadcast(chosen), slim["_key"] == chosen["_id"]).select("_id", "_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in text_slices(batch.column(2), rows=ROWS):
                rows = term_counts(buf, offsets)
                packed = [r.astype("<f4").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(packed, pa.binary())], names=["id", "label", "terms"])

    # equal ids may stand in several rows; the sample stays bounded by taking the least of each
    rows = sample.mapInArrow(run, "id long, label int, terms binary").groupBy("id", "label").agg(F.min("terms").alias("terms")).orderBy("id").collect()
    counts = np.array([np.frombuffer(r["terms"], "<f4") for r in rows], np.float32).reshape(-1, TERMS)
    there_are = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    return fit_model(counts, np.array([r["label"] for r in rows]), there_are)


def scorer(model: Callable[[], Model | None]) -> Callable[[pa.Array], dict[str, object]]:
    def compute(column: pa.Array) -> dict[str, object]:
        fitted = model()
        score = np.zeros(len(column))
        for i, j, buf, offsets in text_slices(column, rows=ROWS):
            score[i:j] = 0.5 if fitted is None else fitted.score(term_counts(buf, offsets))
        score = np.clip(score, 0, 1)
        return {"score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return compute


def classify(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``score`` and ``predicted`` appended; the model is broadcast once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_computed(docs, [text], FIELDS, scorer(lambda: sent.value))
