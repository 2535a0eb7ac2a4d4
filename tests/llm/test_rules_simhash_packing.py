from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm import packing, quality_rules, simhash
from tallyline.llm.shared import components, ship
from tests.llm import brute

ODD = [
    None, "", " \n\t ", "word", "a b c", "A b c D", "x " * 3000, "\x1c\x1f é Ü ŉ ß İ Σας", "日本語 テキスト 12 345", "don't we'll I'M 's 'S it''s",
    "<|startoftext|> hi <|endoftext|>", "é ́x", "tab\tnew\nline\rcr\x0bvt\x0cff", "$$$ *** ### %%% <><>", "\U0001f600‍️ ok", "a\x00b",
]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    rows = [(i, t, "u", 1) for i, t in enumerate(ODD)] + [(3, "word", "u", 1), (None, "null id text", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_WORDS string, kept int")


@pytest.fixture(scope="module")
def docs(spark, sf):
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_rules_match_brute_force(docs, odd):
    for frame in (docs, odd):
        made, names = quality_rules.judge(frame)
        fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        rows = made.select("text", *[names[f] for f in fields], names["kept"]).collect()
        assert len(rows) == frame.count()
        for row in rows:
            assert tuple(row[1:7]) == brute.rules_base(row[0]), row[0]
            assert not (row[7] and brute.rules_base(row[0])[5])


def test_rules_keep_clean_and_reject_menus(spark):
    clean = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(5))
    menu = "Home | About us | Contact | Products | Help\n" * 1 + "\n".join("Item %d | Offer %d | More %d | Link %d" % (i, i, i, i) for i in range(9))
    frame = spark.createDataFrame([(1, clean), (2, menu)], "doc_id long, text string")
    assert dict(quality_rules.judge(frame)[0].select("doc_id", "kept").collect()) == {1: True, 2: False}


def test_simhash_matches_brute_force(docs, odd):
    for frame in (docs, odd.filter("doc_id is not null")):
        rows = frame.select("doc_id", "text").collect()
        want = {}
        prints = {r[0]: brute.simhash(r[1]) for r in rows}
        want = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
        got = simhash.near_groups(frame).collect()
        assert len(got) == len(rows)
        assert {(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got} == {(d, prints[d], want[d]) for d in prints}


def test_simhash_null_id_and_empty(spark, odd):
    assert odd.count() == simhash.near_groups(odd).count()
    assert simhash.near_groups(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 3").count() == 1


def test_fuzzy_keys_meet_for_all_pairs_within_four_bits():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            b ^= 1 << int(bit)
        key, row = simhash.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_large_groups_give_a_forest(spark):
    rng = np.random.default_rng(5)
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    a, b = simhash.links_of(np.zeros(len(fps), np.uint64), fps, np.arange(len(fps)))
    assert len(a) == len(fps) - 1 and set(a) == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_word_ids_match_the_library(docs, odd):
    path = public_tokenizers.path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for frame in (docs, odd):
        column = frame.select("text").toArrow().column(0).combine_chunks()
        texts = [t or "" for t in column.to_pylist()]
        for (row, ids), want in zip(packing.token_ids(column, path), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids.tolist() == want.ids, texts[row][:200]


def test_packing_is_whole_gapless_and_tight(docs, odd):
    path = public_tokenizers.path(packing.VOCABULARY)
    for frame, capacity in ((docs, 2048), (odd, 64)):
        rows = packing.pack(frame, capacity).collect()
        column = frame.select("text").toArrow().column(0).combine_chunks()
        want = Counter()
        for _, ids in packing.token_ids(column, path):
            whole = [*ids.tolist(), 0]
            for k, at in enumerate(range(0, len(whole), capacity)):
                want[(k, at, len(whole[at : at + capacity]), zlib.crc32(np.array(whole[at : at + capacity], "<u4").tobytes()))] += 1
        assert want == Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(sequences) == len(plain_best_fit([r["length"] for r in rows], capacity))
    assert packing.pack(odd.limit(0)).count() == 0


def plain_best_fit(lengths: list[int], capacity: int) -> list[int]:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_equals_piece_by_piece_best_fit():
    rng = np.random.default_rng(11)
    for trial in range(60):
        capacity = int(rng.integers(5, 70))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 300))).tolist()
        plan = packing.best_fit(dict(Counter(lengths)), capacity)
        used: Counter = Counter()
        for length, _, ranks, first, per, offset in plan:
            for i in range(ranks):
                assert offset + (i % per + 1) * length <= capacity
                used[first + i // per] += length
        assert sorted(capacity - u for u in used.values()) == plain_best_fit(lengths, capacity)
        assert sum(used.values()) == sum(lengths)


def test_query_rows_are_one_per_document(spark, sf):
    from tallyline.llm import queries

    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op9_quality_rules", "op10_simhash_near_dedup"):
        got = queries.QUERIES[name](spark, sf)
        assert got.count() == n and got.select(F.countDistinct("doc_id")).first()[0] == n
