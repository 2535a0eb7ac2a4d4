from __future__ import annotations

import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyline.llm import arrays, byte_bpe, packing, quality_rules, substring_dedup
from tallyline.llm.shared import ship
from tests.llm import brute

# two words of 1,024 letters that a polynomial modulo 2^64 cannot tell apart, whatever its base
WORD = b"a"
for _ in range(10):
    WORD += bytes(195 - c for c in WORD)
OTHER = bytes(195 - c for c in WORD)
PAIR = f"{WORD.decode()} {OTHER.decode()} "


def test_hashes_tell_words_apart_and_do_not_depend_on_the_place():
    found = [WORD, OTHER, b"", b"x", b"xx"] + [bytes(p) for p in itertools.permutations(b"abcdefgh")]
    buf = np.frombuffer(b" ".join(found), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = ends - [len(w) for w in found]
    h = arrays.span_hashes(buf, starts, ends)
    assert len(np.unique(h)) == len(found)
    alone = [arrays.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in found[:200]]
    assert alone == h[:200].tolist()


def test_packing_and_encoding_of_the_pair_equal_the_library(spark):
    ship(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [PAIR * 2, OTHER.decode(), "é " + PAIR]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for _, ids in packing.token_ids(pa.array(texts), path, True)] == want
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = byte_bpe.decode(byte_bpe.encode(frame)).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in made} == dict(enumerate(texts))


def test_rules_and_passages_do_not_take_the_pair_for_a_repeat(spark):
    text = " ".join(f"{WORD.decode() if i % 2 else OTHER.decode()}{i if i < 8 else ''}" for i in range(8)) + " " + " ".join([WORD.decode()] * 8) + " " + " ".join([OTHER.decode()] * 8)
    got = quality_rules.measure(pa.array([text]))["n_repeat_words"][0]
    assert got == brute.rules_base(text)[4]
    one, two = " ".join([WORD.decode()] * 50), " ".join([OTHER.decode()] * 50)
    frame = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.deduplicate(frame).collect()} == {1: 0, 2: 0, 3: 50}


def test_kept_words_change_no_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"w{(i * j) % 17}é{i % 5}" if j % 3 else f"Word{(i + j) % 11}" for j in range(40)) for i in range(60)] + ["", None, PAIR, "w1é1"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for most in (5, 40, 400_000):
        monkeypatch.setattr(packing, "KEPT_WORDS", most)
        monkeypatch.setattr(packing, "_encoders", {})
        for i in range(0, len(texts), 8):
            got = [ids.tolist() for _, ids in packing.token_ids(pa.array(texts[i : i + 8], pa.string()), path, True)]
            assert got == want[i : i + 8]
        assert len(packing.encoder(path).known.hash) <= max(most, 150)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "_encoders", {})
    monkeypatch.setattr(packing, "span_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    library = Tokenizer.from_file(path)
    for text in ("one three", "two seven", "six three", "one"):
        got = [ids.tolist() for _, ids in packing.token_ids(pa.array([text]), path)]
        assert got == [library.encode(text, add_special_tokens=False).ids]
