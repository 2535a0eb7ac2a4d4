"""What the review of round 2 found missing."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyline.llm import langid, packing, queries, simhash
from tallyline.llm.shared import ship

CYRILLIC = "съешь же ещё этих мягких французских булок да выпей чаю"
CJK = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
LATIN = "the quick brown fox jumps over the lazy dog 0123456789 +-=@#$%&*()[]{}<>/\\|;:'\",.?!_~^` "


def longest_matches(text: bytes, sample: bytes) -> int:
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


def test_every_byte_of_a_rare_language_is_learned():
    samples = {"en": LATIN.encode() * 300, "de": LATIN.upper().encode() * 300, "ru": CYRILLIC.encode(), "zh": CJK.encode()}
    model = langid.fit_model(samples)
    for text in (CYRILLIC, CJK, CYRILLIC[7:30], CJK[3:11], CJK + CYRILLIC, "+-=@ fox"):
        raw = text.encode()
        got = langid.phrases(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        assert got == [longest_matches(raw, samples[k]) for k in model.languages], text

def test_keep_one_keeps_null_ids_and_different_texts_under_one_id(spark):
    ship(spark)
    texts = [" ".join(f"{w}{i}x{j}" for j in range(40)) for i, w in enumerate(("ash", "oak", "elm", "fir", "yew"))]
    rows = [(None, texts[0], "a"), (7, texts[1], "b"), (7, texts[2], "c"), (None, texts[3], "d"), (9, texts[3], "e"), (8, texts[3], "f"), (None, texts[4], "g"), (None, texts[4], "g")]
    frame = spark.createDataFrame([*rows, (5, None, "h"), (5, "", "i"), (None, " ", "j")], "doc_id long, text string, _fp string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    want = [(None, texts[0], "a"), (7, texts[1], "b"), (7, texts[2], "c"), (8, texts[3], "f"), (None, texts[4], "g"), (5, "", "i")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_null_id_near_copy_is_named_after_a_reachable_id(spark):
    ship(spark)
    frame = spark.createDataFrame([(None, "one and the same text"), (4, "One and the  same text"), (None, "nobody's copy")], "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.near_groups(frame).select("doc_id", "component_id").collect()), key=str)
    assert got == [(4, 4), (None, 4), (None, None)]


def test_added_tokens_are_packed_as_the_unmodified_library_gives_them(spark, tmp_path):
    ship(spark)
    texts = ["hi <|endoftext|> you", "hi<|endoftext|>You", "HI <|ENDOFTEXT|> x", "<|startoftext|>é <|endoftext|><|endoftext|>", None, "", "plain words", "<|endof", "text|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {}
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert want[0][0] == 4
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op5_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got.collect()} == want
