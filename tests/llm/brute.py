"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def simhash(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items: dict[int, object], linked) -> dict[int, int]:
    """Smallest id reachable, by comparing everything."""
    ids = sorted(items)
    name = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j <= i:
                continue
            if linked(items[i], items[j]) and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    return name


def repeated_bytes(docs: list[tuple[int, bytes]], length: int) -> dict[int, bytes]:
    """doc_id -> flags of removed bytes; docs in order."""
    first: dict[bytes, tuple[int, int]] = {}
    out = {}
    for doc, text in docs:
        flags = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if first.setdefault(text[i : i + length], (doc, i)) != (doc, i):
                flags[i : i + length] = b"\x01" * length
        out[doc] = bytes(flags)
    return out


def repeated_words(docs: list[tuple[int, str]], length: int) -> dict[int, list[bool]]:
    """doc_id -> flags of removed words; docs in order of doc_id."""
    first: dict[tuple, int] = {}
    out = {}
    for doc, text in docs:
        words = WORD.findall(text or "")
        flags = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first.setdefault(tuple(words[i : i + length]), doc) != doc:
                flags[i : i + length] = [True] * length
        out[doc] = flags
    return out
