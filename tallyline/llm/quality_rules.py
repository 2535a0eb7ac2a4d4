"""Quality rules, line first: judge every line, drop what fails, reject documents that lose too much.

A line fails if it is

* navigation: at least a fifth of its words are menu separators (``|``, ``»``, ``›``, ``>``, ``•``, ``·``);
* boilerplate: it holds one of the phrases of ``BOILERPLATE``, in any case, and has at most ``BOILERPLATE_WORDS`` words;
* shouting: three words or more and no lower-case letter among its letters;
* clutter: symbols of ``[#*$%&|<>]`` are more than a tenth of its word characters;
* a stub: fewer than ``STUB_WORDS`` words and no sentence-ending punctuation;
* a repeat: equal to an earlier line of the document that has at least ``REPEAT_WORDS`` words.

``clean`` returns the kept documents without their failed lines; ``judge`` the
counts and the verdict of every document. Lines without a word are left alone.

A document is kept if the base checks pass and at least ``KEEP_SHARE`` of its
word characters stand in lines that did not fail.

Null text is a text without words: all counts are 0, the base check fails, it
is not kept. Empty and blank texts likewise. Repeated rows are judged each on
its own. Very long texts are one slice of their own; nothing is cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import covered, mix, per_text, runs_of, span_hashes, text_slices, words
from .shared import with_computed

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
KEEP_SHARE = 0.5
STUB_WORDS = 5
REPEAT_WORDS = 3
BOILERPLATE_WORDS = 40
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "uses cookies",
    "enable javascript", "sign up for our newsletter", "subscribe to our newsletter", "click here", "skip to content", "lorem ipsum",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_MENU = frozenset("|»›>•·")
_ENDING = re.compile(r"[.!?…:;。！？][\"'”’»)\]*]*$")

FIELDS = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(), "lost_share": T.DoubleType(),
}


def line_fails(line: str, n_chars: int, parts: list[str], repeated: bool) -> bool:
    """Whether a line with at least one word is removed. ``parts`` are its words, ``n_chars`` their code points."""
    n = len(parts)
    if repeated and n >= REPEAT_WORDS:
        return True
    if n < STUB_WORDS and not _ENDING.search(parts[-1]):
        return True
    if n >= 3 and line.isupper():
        return True
    menu = sum(map(parts.count, _MENU))
    if menu * 5 >= n:
        return True
    symbols = sum(map(line.count, "#*$%&|<>"))
    if symbols * 10 > n_chars:
        return True
    return n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line) is not None


def _lines(text: str) -> tuple[int, float, str]:
    """Lines with a word that equal an earlier line; share of the word characters in removed lines; the text without those."""
    seen: set[str] = set()
    kept: list[str] = []
    repeats = total = lost = 0
    for line in text.split("\n"):
        parts = [w for w in _SPLIT.split(line) if w]
        if not parts:
            kept.append(line)
            continue
        again = line in seen
        if again:
            repeats += 1
        else:
            seen.add(line)
        n_chars = sum(map(len, parts))
        total += n_chars
        if line_fails(line, n_chars, parts, again):
            lost += n_chars
        else:
            kept.append(line)
    return repeats, (lost / total if total else 0.0), "\n".join(kept) if lost else text


def _measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, first = words(buf, offsets)
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    repeat = np.zeros(len(starts), bool)
    if len(starts) >= REPEAT_WINDOW:
        window = runs_of(span_hashes(buf, starts, ends), REPEAT_WINDOW)
        at = np.flatnonzero(text_of[: len(window)] == text_of[REPEAT_WINDOW - 1 :])
        key = mix(window[at] + text_of[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found = at[twice]
        repeat = covered(len(starts), found, found + REPEAT_WINDOW)
    point = (buf & 0xC0) != 0x80
    return {
        "n_words": counts, "word_chars": per_text(point & ~_SPACE[buf], offsets), "n_symbols": per_text(_SYMBOL[buf], offsets),
        "n_repeat_words": per_text(repeat, first),
    }


def measure(column: pa.Array) -> dict[str, object]:
    """All fields of ``FIELDS`` for a column of texts, and ``cleaned``, the texts without the lines that failed (null stays null)."""
    parts = [_measure(buf, offsets) for _, _, buf, offsets in text_slices(column)]
    out: dict[str, object] = {k: np.concatenate([p[k] for p in parts]) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    lines = [_lines(t or "") for t in column.to_pylist()]
    out["n_dup_lines"] = np.array([r for r, _, _ in lines], np.int64)
    lost = np.array([s for _, s, _ in lines], float)
    out["cleaned"] = pa.array([None if t is None else line[2] for t, line in zip(column.to_pylist(), lines, strict=True)], pa.string())
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["lost_share"] = lost
    out["kept"] = ~out["base_failed"] & (lost <= 1 - KEEP_SHARE)
    return out


def judge(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts and the verdict of every row appended; see the module for each case."""
    return with_computed(docs, [text], FIELDS, measure)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of ``docs`` and without the lines that failed."""
    made, names = with_computed(docs, [text], FIELDS | {"cleaned": T.StringType()}, measure)
    columns = [F.col(names["cleaned"]).alias(c) if c == text else F.col(c) for c in docs.columns]
    return made.filter(names["kept"]).select(*columns)
