from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import chat, queries, quality_knn, quality_rules, simhash
from tallyline.llm.shared import ship
from tests.compare import compare
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, sf, name):
    assert compare(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df()) is None


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\>im_endx\n") for _ in range(rng.randint(0, 14)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
        turn, a, b = chat.render("assistant", text)
        assert chat.read_turn(turn) == ("assistant", text) and chat.unescape(turn[a:b]) == text
    assert chat.render("user", "x")[1:] == (len("<|im_start|>user\n"),) * 2


LOG = [
    # (conv, message, seq, kind, role, text)
    (1, 1, 1, "start", "user", "hel"), (1, 1, 2, "delta", None, "lo"), (1, 2, 3, "start", "assistant", "bad "), (1, 2, 4, "delta", None, "answer"),
    (1, 3, 5, "start", "user", "follows the bad answer"), (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "good"), (1, 3, 8, "start", "user", "thanks"),
    (1, 3, 9, "edit", None, "thank you"), (2, 1, 1, "delta", "user", "no start"), (3, None, None, None, None, None), (None, 1, 1, "start", "assistant", "<|im_end|>"),
]


def test_log_is_folded_into_final_messages(spark):
    ship(spark)
    frame = spark.createDataFrame(LOG, "conv_id long, message long, seq long, kind string, role string, text string").withColumn("extra", F.lit(1))
    turns = chat.format_log(frame).collect()
    got: dict = {}
    for r in turns:
        assert r["position"] == sum(len(t) for t, _ in got.get(r["conv_id"], []))
        got.setdefault(r["conv_id"], []).append((r["turn"], r["turn"][r["loss_start"] : r["loss_end"]]))
    said = {k: [chat.read_turn(t) for t, _ in v] for k, v in got.items()}
    assert said == {
        1: [("user", "hello"), ("assistant", "good"), ("user", "thank you")], 2: [("user", "no start")], 3: [("", "")], None: [("assistant", "<|im_end|>")],
    }
    assert [mask for _, mask in got[1]] == ["", "good", ""]
    assert chat.format_log(frame.limit(0)).count() == 0 and chat.digests(chat.format_log(frame.limit(0))).count() == 0
    digest = {r["conv_id"]: r for r in chat.digests(chat.format_log(frame)).collect()}
    assert digest[1]["turns_sha256"] == hashlib.sha256(b"user\nhello\nassistant\ngood\nuser\nthank you\n").hexdigest()
    assert (digest[1]["loss_chars"], digest[1]["loss_sha256"]) == (4, hashlib.sha256(b"good").hexdigest())


def test_stages_match_brute_force_on_their_input(spark, sf):
    folder, before = sf, spark.read.parquet(f"{sf}/documents.parquet").withColumn("_keep", F.lit("clash")).withColumn("score", F.lit("clash"))
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder).cache()
        frames[name] = (before, after)
        before = after
    rows = {k: ({r["doc_id"]: r for r in a.collect()}, [r for r in b.collect()]) for k, (a, b) in frames.items()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert frames[name][1].columns == frames[name][0].columns
        assert len({r["doc_id"] for r in rows[name][1]}) == len(rows[name][1])
    given, kept = rows["quality_classifier"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_knn.fit(frames["quality_classifier"][0], labels)
    made, names = quality_knn.classify(frames["quality_classifier"][0], model)
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in made.collect() if r[names["predicted"]] == 1}
    given, kept = rows["quality_rules"]
    verdict = quality_rules.measure(frames["quality_rules"][0].select("text").toArrow().column(0).combine_chunks())["kept"]
    order = [r["doc_id"] for r in frames["quality_rules"][0].collect()]
    assert {r["doc_id"] for r in kept} == {d for d, ok in zip(order, verdict, strict=True) if ok}
    given, kept = rows["simhash_near_dedup"]
    prints = {d: brute.simhash(r["text"]) for d, r in given.items()}
    named = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {r["doc_id"] for r in kept} == {d for d, c in named.items() if d == c}
    given, kept = rows["suffix_array_dedup"]
    gone = brute.repeated_bytes(sorted((d, r["text"].encode()) for d, r in given.items()), 100)
    for r in kept:
        raw = given[r["doc_id"]]["text"].encode()
        want = bytes(b for b, f in zip(raw, gone[r["doc_id"]], strict=True) if not f).decode("utf-8", "ignore")
        assert r["text"] == want and r["n_chars"] == len(want) and r["lang"] == given[r["doc_id"]]["lang"]
    given, packed = rows["best_fit_packing"]
    assert {r["doc_id"] for r in packed} == set(given)
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_stages_take_odd_and_empty_tables(spark, sf):
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x", None, None, None), (3, "a b c " * 900, "en", "s", 1), (3, "a b c " * 900, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, sf).count() <= 20


def test_fingerprint_of_long_repetitive_text():
    text = "a b c d " * 5000
    assert simhash.fingerprint(text.encode()) == brute.simhash(text)
    assert np.bitwise_count(np.uint64(simhash.fingerprint(b"one"))) > 0 and simhash.fingerprint(b" \n") == 0
