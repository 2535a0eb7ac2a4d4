"""Language ID and quality classifier against plain versions of the whole decision."""

from __future__ import annotations

import math
import random

import numpy as np

from tallyline.llm import langid, quality_knn
from tallyline.llm.shared import ship
from tests.llm.test_advice_r02 import longest_matches


def random_texts(seed: int) -> tuple[dict[str, bytes], list[bytes]]:
    rng = random.Random(seed)
    words = [bytes(rng.choice(b"abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(60)]

    def some(n):
        return b" ".join(rng.choice(words) for _ in range(n))

    samples = {"x": some(400), "y": some(300) + b"a" * 1500, "z": b"ab" * 700}
    texts = [some(rng.randint(0, 500)) for _ in range(12)]
    texts += [samples["x"][100:1500], samples["x"][:900] + b"Q" + samples["x"], b"a" * 4000, b"ba" * 777, b"", b"a", b"c" * 256, b"c" * 257, b"b" + b"a" * 1111 + some(200)]
    rng.shuffle(texts)
    return samples, texts


def test_phrases_run_over_the_cuts_of_stretches(monkeypatch):
    samples, texts = random_texts(1)
    want = None
    for lanes in (4096, 3, 1):
        monkeypatch.setattr(langid, "LANES", lanes)
        model = langid.fit_model(samples)
        offsets = np.cumsum([0] + [len(t) for t in texts])
        got = langid.phrases(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
        want = want or [[longest_matches(t, samples[k]) for k in model.languages] for t in texts]
        assert got.tolist() == want, lanes


def test_share_of_the_sample():
    assert langid.even_share([10] * 5, 100) == 10
    assert langid.even_share([1, 2, 1000, 1000], 103) == 50
    assert langid.even_share([100_000], 32_768) == 32_768
    assert langid.even_share([9, 9, 9], 3) == 1


def test_the_whole_decision_equals_a_plain_one(spark, monkeypatch):
    ship(spark)
    rng = random.Random(5)
    letters = {"aa": "ehilo nrst", "bb": "aeimn ouvz", "cc": "жийкл мопр"}
    made = {k: ["".join(rng.choice(v) for _ in range(5)) for _ in range(40)] for k, v in letters.items()}
    rows = [(i, " ".join(rng.choice(made[k]) for _ in range(rng.randint(1, 60))).title(), k) for i, k in enumerate(rng.choices(list(letters), k=90))]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 ½", "aa"), (503, rows[0][1], None), (None, rows[1][1], "cc"), rows[2]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled = {}
    plain = langid.fit_model
    monkeypatch.setattr(langid, "fit_model", lambda samples: (sampled.update(samples), plain(samples))[1])
    model = langid.fit(frame)
    # texts are smaller than the budget, so the samples are all learned texts, whole, each once
    learned = {k: sorted({t.lower() for i, t, lang in rows if lang == k and t and i is not None and not held(i)}) for k in letters}
    learned["aa"] = sorted({*learned["aa"], *(["12 ½"] if not held(502) else [])})
    assert {k: sorted(v.decode().split("\n")) for k, v in sampled.items()} == learned
    got = langid.identify(frame, model)[0].collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["text"]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        raw = text.lower().encode()
        cost = sorted((longest_matches(raw, v) * math.log2(len(v) + 1) / len(raw), k) for k, v in sampled.items())
        assert r["lang_pred"] == cost[0][1]
        assert math.isclose(r["score"], cost[1][0] / (cost[0][0] + cost[1][0]))


def held(doc_id: int) -> bool:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_samples_are_spans_of_whole_texts(spark, monkeypatch):
    ids = [i for i in range(400) if not held(i)][:40]
    head = "same heading " * 200
    frame = spark.createDataFrame([(i, head + f"tail{i} words{i} " * 400, "en") for i in ids], "doc_id long, text string, lang string")
    sampled = {}
    monkeypatch.setattr(langid, "fit_model", sampled.update)
    langid.fit(frame)
    spans = sampled["en"].decode().split("\n")
    assert len(spans) == len(ids) and {len(s) for s in spans} == {langid.SAMPLE_BYTES // len(ids)}
    assert sum("tail" in s for s in spans) > len(ids) // 2


def test_scores_are_weighted_cosine_votes():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.02, (120, quality_knn.TERMS)).astype(np.float32)
    labels = (rng.random(120) < 0.4).astype(int)
    rows = {0: 900, 1: 100}
    model = quality_knn.fit_model(counts, labels, rows)
    asked = np.vstack([rng.poisson(0.02, (30, quality_knn.TERMS)), counts[:5], np.zeros((1, quality_knn.TERMS))]).astype(np.float32)
    got = model.score(asked)
    weight_of = [rows[v] / (labels == v).sum() for v in labels]
    for text, score in zip(asked, got, strict=True):
        x = np.log1p(text[model.columns]) * model.idf
        x = x / max(1e-12, math.sqrt(float(x @ x)))
        z = x @ model.directions
        z = z / max(1e-12, math.sqrt(float(z @ z)))
        near = sorted(((-float(z @ v), k) for k, v in enumerate(model.vectors)))[: quality_knn.NEIGHBOURS]
        votes = [(min(1.0, max(0.0, -c)) ** quality_knn.POWER * weight_of[k], labels[k]) for c, k in near]
        total = sum(w for w, _ in votes)
        want = sum(w * v for w, v in votes) / total if total > 1e-12 else 0.1
        assert math.isclose(score, want, rel_tol=1e-3, abs_tol=1e-6)
    assert math.isclose(got[-1], 0.1)


def test_ids_of_two_labels_or_texts_fit_one_model(spark):
    ship(spark)
    docs = [(i, f"text number {i} with some words. " * (1 + i % 4)) for i in range(60)]
    labels = [(i, i % 2) for i in range(60)]
    extra = [(3, "another text | of # id 3"), (5, None)]
    models = []
    for seed in (1, 2):
        shuffled = docs + extra
        random.Random(seed).shuffle(shuffled)
        both = labels + [(8, 1), (9, 0)]
        random.Random(seed).shuffle(both)
        frame = spark.createDataFrame(shuffled, "doc_id long, text string")
        models.append(quality_knn.fit(frame, spark.createDataFrame(both, "doc_id long, quality int")))
    assert (models[0].vectors == models[1].vectors).all() and (models[0].labels == models[1].labels).all()
    assert len(models[0].labels) == sum(not held(i) for i in range(60) if i not in (8, 9))


def test_equal_neighbours_are_taken_in_the_order_of_the_sample():
    counts = np.zeros((40, quality_knn.TERMS), np.float32)
    counts[:, :4] = 3
    labels = np.array([1] * 10 + [0] * 30)
    model = quality_knn.fit_model(counts, labels)
    model.vectors[:] = model.vectors[0]
    assert model.score(counts[:3]).tolist() == [10 / quality_knn.NEIGHBOURS] * 3
