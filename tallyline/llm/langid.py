"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text
recognises every substring of that sample. A text is parsed greedily into the
longest phrases found there; where the next byte cannot continue, a new phrase
starts. Phrases times log2(sample length), per byte, estimate the entropy of
the text under that language; the smallest wins.

The automata become dense tables (state by byte class; every byte value that
occurs in a language's sample has a class of its own there). Stretches of
``STRETCH`` bytes walk through a table in lockstep, each as if a phrase began
there. The parse that comes out of a stretch then runs on through the next one
until it is in the state that the next one's own walk had at that byte: from
there on both agree. So a phrase may be of any length, and the counts are those
of one parse from the first byte to the last.

Sample bound: ``SAMPLE_DOCS`` documents per language (chosen by hash) and
``SAMPLE_BYTES`` bytes. The bytes are shared evenly among the chosen documents;
what short ones leave goes to longer ones. A document longer than its share
gives a span at a hashed place of its whole text. Text is lower-cased first.

Null texts and texts without a letter are ``und`` with score 0. Without any
labelled row everything is ``und``. Ties go to the language first in order.
Null languages and null ids are not learned. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import text_slices
from .quality_knn import SHARES, held_out
from .shared import with_computed

SAMPLE_DOCS = 256
SAMPLE_BYTES = 32_768
STRETCH = 256
# stretches that walk together
LANES = 4096
UNKNOWN = "und"
# the upper two bits of an entry count the phrases that end at this byte
_ONE, _SHIFT = np.uint32(1 << 30), np.uint32(30)
_STATE = np.uint32((1 << 30) - 1)

FIELDS = {"lang_pred": T.StringType(), "score": T.DoubleType()}


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for byte in text:
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in following[at]:
            following[at][byte] = state
            at = link[at]
        if at >= 0:
            there = following[at][byte]
            if length[at] + 1 == length[there]:
                link[state] = there
            else:
                twin = len(following)
                following.append(dict(following[there]))
                length.append(length[at] + 1)
                link.append(link[there])
                while at >= 0 and following[at].get(byte) == there:
                    following[at][byte] = twin
                    at = link[at]
                link[there] = link[state] = twin
        last = state
    return following


def byte_classes(sample: bytes) -> tuple[np.ndarray, int]:
    """The class of each byte value, and their number: 0 is any byte that the sample lacks."""
    own = np.unique(np.frombuffer(sample, np.uint8))
    class_of = np.zeros(256, np.uint32)
    class_of[own] = np.arange(1, 1 + len(own))
    return class_of, 1 + len(own)


def dense_table(following: list[dict[int, int]], class_of: np.ndarray, n_classes: int) -> np.ndarray:
    """Flat table of next offsets (state * classes), with the number of phrases that end in the upper bits.

    Where a byte can't continue a phrase, the open one ends and the byte begins
    the next; a byte that is nowhere in the sample is a phrase of its own.
    """
    start = np.zeros(n_classes, np.uint32)
    for byte, to in following[0].items():
        start[class_of[byte]] = to * n_classes
    table = np.tile(np.where(start > 0, start | _ONE, 2 * _ONE).astype(np.uint32), (len(following), 1))
    table[0] = np.where(start > 0, start, _ONE)
    for state, row in enumerate(following):
        for byte, to in row.items():
            table[state, class_of[byte]] = to * n_classes
    return table.ravel()


@dataclass
class Model:
    languages: list[str]
    classes: list[np.ndarray]
    tables: list[np.ndarray]
    bits: list[float]


def fit_model(samples: dict[str, bytes]) -> Model | None:
    """Automata of one sample per language."""
    samples = {k: v for k, v in samples.items() if v}
    if not samples:
        return None
    languages = sorted(samples)
    classes, tables = [], []
    for k in languages:
        class_of, n_classes = byte_classes(samples[k])
        classes.append(class_of)
        tables.append(dense_table(automaton(samples[k]), class_of, n_classes))
    return Model(languages, classes, tables, [float(np.log2(len(samples[k]) + 1)) for k in languages])


def phrases(model: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of phrases of each text (rows) in each language (columns)."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    per = -(-lengths // STRETCH)
    text_of = np.repeat(np.arange(n), per)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(per) - per, per)
    lane_start = np.repeat(offsets[:-1], per) + nth * STRETCH
    lane_length = np.minimum(STRETCH, offsets[1:][text_of] - lane_start)
    out = np.zeros((n, len(model.languages)), np.int64)
    # the state in which the part before left the text that goes on in this one
    left = [0] * len(model.languages)
    for at in range(0, len(text_of), LANES):
        part = slice(at, at + LANES)
        walk = _Walk(buf, lane_start[part], lane_length[part], text_of[part])
        goes_on = nth[at] > 0
        for k, (class_of, table) in enumerate(zip(model.classes, model.tables, strict=True)):
            counts, left[k] = walk.through(class_of, table, left[k] if goes_on else 0)
            out[: walk.texts[-1] + 1, k] += np.bincount(walk.texts, counts).astype(np.int64)
    return out


class _Walk:
    """Consecutive stretches of texts, walked through one table after another."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, texts: np.ndarray):
        # longest first: at each byte the stretches that reach it stand in front
        self.order = np.argsort(-lengths, kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))
        self.lengths, self.texts = lengths, texts
        steps = np.arange(int(lengths.max()))
        self.reach = np.searchsorted(-lengths[self.order], -steps, side="left")
        self.values = buf[np.minimum(starts[self.order][None, :] + steps[:, None], len(buf) - 1)]
        follows = np.zeros(len(texts), bool)
        follows[1:] = texts[1:] == texts[:-1]
        self.follows = follows

    def through(self, class_of: np.ndarray, table: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Phrases that begin in each stretch (their sum per text is exact), and the state at the end; the first begins in ``state``."""
        lanes = len(self.order)
        codes = class_of[self.values]
        states = np.zeros((len(codes) + 1, lanes), np.uint32)
        begun = np.zeros((len(codes) + 1, lanes), np.uint16)
        states[0, self.place[0]] = state
        for step, m in enumerate(self.reach):
            now = states[step, :m]
            moved = table[now + codes[step, :m]]
            states[step + 1, :m] = moved & _STATE
            begun[step + 1, :m] = begun[step, :m] + ((now == 0) | (moved >= _ONE))
        place, lengths = self.place, self.lengths
        end = states[lengths, place]
        counts = begun[lengths, place].astype(np.int64)
        last = int(end[-1])
        at = np.flatnonzero(self.follows)
        if not len(at):
            return counts, last
        # what comes out of the stretch before runs on until it meets the walk of this one
        met, gone = np.full(lanes, -1), np.zeros(lanes, np.int64)
        run, running = end[at - 1], at
        for step in range(len(codes) + 1):
            same = run == states[step, place[running]]
            met[running[same]] = step
            on = ~same & (lengths[running] > step)
            run, running = run[on], running[on]
            if not len(running):
                break
            moved = table[run + codes[step, place[running]]]
            gone[running] += (run == 0) | (moved >= _ONE)
            run = moved & _STATE
        synced = at[met[at] >= 0]
        counts[synced] += gone[synced] - begun[met[synced], place[synced]]
        # stretches that are not met within themselves: from the first of a row of them, byte by byte
        lane = 0
        for lane_missed in np.flatnonzero(self.follows & (met < 0)).tolist():
            if lane_missed < lane:
                continue
            lane, run = lane_missed, int(end[lane_missed - 1])
            found = False
            while not found and lane < lanes and (lane == lane_missed or self.follows[lane]):
                n = 0
                for step in range(int(lengths[lane]) + 1):
                    if lane > lane_missed and run == states[step, place[lane]]:
                        counts[lane] = n + int(begun[lengths[lane], place[lane]]) - int(begun[step, place[lane]])
                        found = True
                        break
                    if step == lengths[lane]:
                        break
                    moved = int(table[run + int(codes[step, place[lane]])])
                    n += run == 0 or moved >= int(_ONE)
                    run = moved & int(_STATE)
                if not found:
                    counts[lane] = n
                lane += 1
            if not found and lane == lanes:
                last = run
        return counts, last


def even_share(sizes: list[int], budget: int) -> int:
    """The most that each may give so that all together give ``budget``, where smaller ones give all they have."""
    for k, size in enumerate(sorted(sizes)):
        share = budget // (len(sizes) - k)
        if size >= share:
            return share
        budget -= size
    return max(sizes)


def fit(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """Learn from rows that are not held out and have a language; see the module for the bound."""
    spark = docs.sparkSession
    known = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(lang).cast("string").alias("_lang"), F.lower(F.col(text).cast("string")).alias("_text"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & (F.length("_text") > 0) & ~held_out("_id"))
    key = ["_lang", "_id", "_name"]
    known = known.withColumn("_name", F.xxhash64("_text"))
    # a language may hold most rows: the sample is drawn from shares of it first
    part = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(SHARES))
    chosen = known.select(*key, F.octet_length("_text").alias("_size"), part.alias("_share"))
    for keys in (["_lang", "_share"], ["_lang"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("_id"), "_id", "_name"))
        chosen = chosen.withColumn("_nth", nth).filter(F.col("_nth") <= SAMPLE_DOCS)
    # at most SAMPLE_DOCS rows a language; a repeated row is learned once
    rows = {(r["_lang"], r["_id"], r["_name"]): r["_size"] for r in chosen.collect()}
    if not rows:
        return None
    sizes: dict[str, list[int]] = {}
    for (language, _, _), size in rows.items():
        sizes.setdefault(language, []).append(size)
    shares = {k: even_share(v, SAMPLE_BYTES) for k, v in sizes.items()}
    wanted = spark.createDataFrame([(*k, shares[k[0]]) for k in rows], "_lang string, _id long, _name long, _most int")
    place = F.pmod(F.xxhash64("_name", F.lit(11)), F.greatest(F.lit(1), F.length("_text") - F.col("_most") + 1))
    spans = known.join(F.broadcast(wanted), key).select(*key, "_most", F.substring(F.col("_text"), (place + 1).cast("int"), F.col("_most")).alias("_span"))
    samples: dict[str, list[bytes]] = {}
    for row in spans.dropDuplicates(key).orderBy(*key).collect():
        samples.setdefault(row["_lang"], []).append(row["_span"].encode()[: row["_most"]])
    return fit_model({k: b"\n".join(v) for k, v in samples.items()})


def predictor(model: Callable[[], Model | None]) -> Callable[[pa.Array], dict[str, object]]:
    def compute(column: pa.Array) -> dict[str, object]:
        fitted = model()
        n = len(column)
        has_letter = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
        best, score = np.zeros(n, np.int64), np.zeros(n)
        if fitted is not None:
            for i, j, buf, offsets in text_slices(pc.utf8_lower(column)):
                cost = phrases(fitted, buf, offsets) * np.array(fitted.bits) / np.maximum(1, np.diff(offsets))[:, None]
                rank = np.argsort(cost, axis=1, kind="stable")
                best[i:j] = rank[:, 0]
                low = np.take_along_axis(cost, rank[:, :1], 1)[:, 0]
                if cost.shape[1] > 1:
                    high = np.take_along_axis(cost, rank[:, 1:2], 1)[:, 0]
                    score[i:j] = high / np.maximum(low + high, 1e-12)
                else:
                    score[i:j] = 1.0
        known = has_letter & (fitted is not None)
        names = np.array(fitted.languages if fitted else [UNKNOWN], object)
        return {"lang_pred": np.where(known, names[best], UNKNOWN).tolist(), "score": np.where(known, np.clip(score, 0, 1), 0.0)}

    return compute


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``lang_pred`` and ``score`` appended; the tables are broadcast once (bounded per language)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_computed(docs, [text], FIELDS, predictor(lambda: sent.value))
