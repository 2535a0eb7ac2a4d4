from __future__ import annotations

import math
import random
import re
from collections import Counter

from tallyline.llm import lexical
from tallyline.llm.shared import ship


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(lexical.TERM, low)


def plain_search(docs, items, k):
    held = [(doc, Counter(terms(text))) for doc, text in docs]
    held = [(doc, c) for doc, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, of in wanted.items():
        scored = []
        for doc, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in of if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(scored[:k])]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def found(spark, docs, items, k, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return [tuple(r) for r in lexical.search(d, b, k, **more).collect()]


def test_search_equals_plain_scoring(spark):
    ship(spark)
    rng = random.Random(3)
    vocabulary = ["a", "ab", "b", "Ab", "é", "É", "naïve", "x1", "1", "über-x", "日本", "the", "The", " q", "aa", "aaa"]
    gaps = [" ", "  ", "\n", "-", "_", ".", "\x00", "\x7f", "", "@", "["]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))

    docs = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(None, text(9)), (None, text(9)), (7, text(5)), (500, None), (501, ""), (502, "...")]
    docs += [(600 + i, "ab é the") for i in range(90)] + [(900, text(60_000))]
    items = [(i, text(rng.randint(0, 8))) for i in range(40)] + [(3, text(4)), (None, "ab x1"), (77, None), (78, "- ."), (79, "nowhere")]
    for k in (1, 7, 50):
        want = sorted(plain_search(docs, items, k), key=key)
        assert sorted(found(spark, docs, items, k), key=key) == want
        assert sorted(found(spark, docs, items, k, most_items=6), key=key) == want


def test_empty_sides_give_no_rows(spark):
    assert found(spark, [], [(1, "a")], 5) == [] and found(spark, [(1, "a")], [], 5) == []
    assert found(spark, [(1, None), (2, "--")], [(1, "a")], 5) == []
    # a single document: its terms are in every document, which weighs floor(1000 ln(4 / 3))
    assert found(spark, [(1, "a")], [(9, "A a")], 5) == [(9, 1, 1, 287 * (1_000_000_000 // (1000 + 20 * 100)))]


def test_best_keeps_ties_by_id_when_cut_often():
    import numpy as np

    rng = random.Random(1)
    best, rows = lexical.Best(2, 3), []
    best.room = 4
    for _ in range(50):
        scores = np.array([[rng.randint(0, 4), rng.randint(0, 4)] for _ in range(5)], np.int64)
        ids = np.array([rng.randint(0, 30) for _ in range(5)], np.int64)
        null = np.array([rng.random() < 0.2 for _ in range(5)])
        best.add(scores, ids, null)
        rows += [(j, -int(s[j]), bool(z), int(d)) for s, d, z in zip(scores, ids, null, strict=True) for j in (0, 1) if s[j] > 0]
    item, score, null, ids = best.cut()
    got = [(int(a), -int(b), bool(c), int(d)) for a, b, c, d in zip(item, score, null, ids, strict=True)]
    assert got == sorted(r for r in rows if r[0] == 0)[:3] + sorted(r for r in rows if r[0] == 1)[:3]
