from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyline.llm import byte_bpe, embed_dedup, langid, quality_knn, queries, substring_dedup, suffix_dedup
from tallyline.llm.shared import ship
from tests.llm import brute
from tests.llm.test_rules_simhash_packing import ODD


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def repeats(spark, docs):
    """Texts with every kind of repeat: inside a text, periodic, at edges, longer and shorter than a window, null and empty."""
    rng = np.random.default_rng(4)
    some = [r["text"] for r in docs.limit(12).collect()]
    base = "".join(rng.choice(list("abcdefgh "), 3000))
    texts = [*ODD, "a" * 99, "a" * 100, "a" * 101, "ab" * 300, "abc" * 90 + "x" + "abc" * 80, "é" * 130, some[3], some[3][:170], "zz" + some[3][5:150], some[5][20:300]]
    for _ in range(12):
        a, b = sorted(rng.integers(0, 3000, 2).tolist())
        texts.append("".join(rng.choice(list("xyz "), 40)) + base[a:b] + "".join(rng.choice(list("xyz "), 40)))
    words = [f"w{i}" for i in rng.integers(0, 60, 400)]
    for _ in range(12):
        a, b = sorted(rng.integers(0, 400, 2).tolist())
        texts.append(" ".join([f"p{i}" for i in rng.integers(0, 9, 7)] + words[a:b] + ["end"]))
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, base[:500], "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("x").alias("chunk")))


def test_suffix_dedup_matches_brute_force(spark, repeats):
    rows = [(r["doc_id"], r["text"]) for r in repeats.select("doc_id", "text").collect()]
    order = sorted(((-1 if d is None else d), (t or "").encode()) for d, t in rows)
    want = brute.repeated_bytes(order, suffix_dedup.LENGTH)
    text = dict(order)
    for chunk_bytes in (4 << 20, 20_000):
        got = suffix_dedup.deduplicate(repeats, chunk_bytes=chunk_bytes).collect()
        assert len(got) == len(rows)
        for r in got:
            d = -1 if r["doc_id"] is None else r["doc_id"]
            flags = bytearray(len(text[d]))
            for s in r["spans"]:
                flags[s["start"] : s["end"]] = b"\x01" * (s["end"] - s["start"])
            assert bytes(flags) == want[d], d
            assert r["n_bytes"] == len(text[d]) and r["kept"] == bytes(b for b, f in zip(text[d], flags, strict=True) if not f)
    assert suffix_dedup.deduplicate(repeats.limit(0)).count() == 0


def test_remove_repeats_keeps_rows_and_columns(repeats):
    made = suffix_dedup.remove_repeats(repeats)
    assert made.columns == repeats.columns and made.count() == repeats.count()


def test_substring_dedup_matches_brute_force(spark, repeats):
    rows = [(r["doc_id"], r["text"]) for r in repeats.select("doc_id", "text").collect()]
    order = sorted(((-1 if d is None else d), (t or "")) for d, t in rows)
    want = brute.repeated_words(order, substring_dedup.LENGTH)
    text = dict(order)
    for chunk_bytes in (4 << 20, 20_000):
        got = substring_dedup.deduplicate(repeats, chunk_bytes=chunk_bytes).collect()
        assert len(got) == len(rows)
        for r in got:
            d = -1 if r["doc_id"] is None else r["doc_id"]
            words = brute.WORD.findall(text[d])
            assert (r["n_words"], r["n_removed"]) == (len(words), sum(want[d])), d
            assert r["kept"] == " ".join(w for w, gone in zip(words, want[d], strict=True) if not gone)
    assert substring_dedup.deduplicate(repeats.limit(0)).count() == 0


def test_bpe_matches_the_library_and_decodes(spark, docs):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, "  a  b", "a\n\n b", "it's I'LL", "x" * 3000, " 　y"])] + [(3, "word"), (None, "no id")], "doc_id long, text string")
    for frame in (docs, odd):
        encoded = byte_bpe.encode(frame)
        want = sorted((repr(r["doc_id"]), library.encode_ordinary(r["text"] or "")) for r in frame.collect())
        assert sorted((repr(r["doc_id"]), r["ids"]) for r in encoded.collect()) == want
        decoded = byte_bpe.decode(encoded).collect()
        assert sorted((repr(r["doc_id"]), bytes(r["decoded"])) for r in decoded) == sorted((repr(r["doc_id"]), (r["text"] or "").encode()) for r in frame.collect())
    assert byte_bpe.encode(odd.limit(0)).count() == 0


def brute_links(rows, threshold):
    usable = [(i, l, np.asarray(v, float)) for i, l, v in rows if i is not None and l is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and any(v)]
    links = {k: 0 for k in range(len(rows))}
    name = {i: i for i, _, _ in rows if i is not None}
    where = {id(u): k for k, u in enumerate(usable)}
    count = [0] * len(usable)
    for a in range(len(usable)):
        for b in range(a + 1, len(usable)):
            (i, l, x), (j, m, y) = usable[a], usable[b]
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                count[a] += 1
                count[b] += 1
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    del links, where
    return {u[0]: c for u, c in zip(usable, count, strict=True)}, name


def test_embedding_links_match_brute_force(spark, sf):
    ship(spark)
    stored = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(400).collect()]
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    near = [(10_000 + i, 77, (centre + rng.normal(size=16) * 0.12).tolist()) for i in range(150)]
    flat = [(20_000 + i, 78, [float(1 + i)] + [0.0] * 3) for i in range(90)]
    odd = [
        (30_000, None, [1.0, 2.0]), (30_001, 5, None), (30_002, 5, []), (30_003, 5, [0.0, 0.0]), (30_004, 5, [1.0, None]), (30_005, 5, [float("nan"), 1.0]),
        (30_006, 5, [1.0, 2.0]), (30_007, 5, [1.0, 2.0]), (30_008, 5, [1e300, 2e300]), (30_009, 5, [1e-300, 2e-300]), (30_010, 5, [float("inf"), 1.0]),
    ]
    rows = stored + near + flat + odd
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    links, name = brute_links([r for r in rows if r[0] not in (30_008, 30_009)], 0.93)
    # the scaled copies of (1, 2): same direction
    for i in (30_008, 30_009):
        name[i] = 30_006
    links |= {30_006: 3, 30_007: 3, 30_008: 3, 30_009: 3}
    for leaf in (1024, 40):
        got = embed_dedup.near_duplicates(frame, leaf=leaf).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["n_links"] == links.get(r["vec_id"], 0), r
            assert r["component_id"] == name[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"]), r
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0
    again = embed_dedup.near_duplicates(frame.limit(1).unionByName(frame.limit(1)).unionByName(spark.createDataFrame([(None, 5, [1.0])], frame.schema)))
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in again.collect()) == sorted([(str(rows[0][0]), 1)] * 2 + [("None", 0)])


def held(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_and_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.op3_language_id(spark, folder).join(truth, "doc_id").collect()
    assert len(rows) == truth.count() and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    checked = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in checked) >= 0.95 * len(checked)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality is not null")
    rows = [r for r in queries.op8_quality_classifier(spark, folder).join(labels, "doc_id").collect() if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_models_on_odd_and_empty_tables(spark):
    ship(spark)
    odd = spark.createDataFrame([(i, t, "q", 0.1) for i, t in enumerate([*ODD, "1234 567 ..."])], "doc_id long, text string, Lang_Pred string, score double")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made, names = langid.identify(odd, langid.fit(docs))
    got = {r["doc_id"]: (r[names["lang_pred"]], r[names["score"]]) for r in made.collect()}
    for i, text in enumerate([*ODD, "1234 567 ..."]):
        assert (got[i][0] == "und") == (not any(c.isalpha() for c in text or "")), text
    empty = docs.limit(0)
    assert langid.fit(empty) is None
    assert {r["lang_pred"] for r in langid.identify(docs.limit(3), None)[0].collect()} == {"und"}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert quality_knn.fit(docs, labels.limit(0)) is None
    made, names = quality_knn.classify(odd, quality_knn.fit(docs, labels))
    assert made.count() == odd.count() and made.filter(F.col(names["score"]).isNull()).count() == 0
    assert {r["score"] for r in quality_knn.classify(docs.limit(3), None)[0].collect()} == {0.5}


def test_phrases_are_greedy_longest_matches():
    samples = {"x": b"banana bandana", "y": b"cabbage"}
    model = langid.fit_model(samples)
    for text in (b"banana", b"nanaban", b"zzz", b"bandcab", b"", b"cabbagebanana"):
        got = langid.phrases(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist()
        want = []
        for k in model.languages:
            n, at = 0, 0
            while at < len(text):
                end = at + 1
                while end <= len(text) and text[at:end] in samples[k]:
                    end += 1
                at = max(end - 1, at + 1)
                n += 1
            want.append(n)
        assert got == want, text
