from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyline.llm import hash_tree
from tallyline.llm.hash_tree import add_weight, even_tree, set_weight
from tallyline.llm.shared import ship

KEYS = 4000


def descend(key, tree):
    """The plain walk down the tree."""
    node, kids = "", hash_tree.children(tree)
    text = "" if key is None else f"={key}"
    for _ in range(hash_tree.LEVELS):

        def draw(child):
            u = (int(hashlib.md5(f"{text}|{child[0]}".encode()).hexdigest()[: hash_tree.DIGITS], 16) + 0.5) / 16**hash_tree.DIGITS
            return -math.log(u) / child[1]

        node, _, shard = min(kids[node], key=draw)
    return shard


def held(spark, tree):
    frame = spark.range(KEYS).select(F.when(F.col("id") > 0, F.col("id")).alias("key"))
    return {r[0]: r[1] for r in frame.select("key", hash_tree.shard_of(F.col("key"), tree)).collect()}


def test_walk_equals_plain_descent_and_follows_weights(spark):
    ship(spark)
    tree = (*even_tree(6, 2, 2), hash_tree.Leaf(6, "r9", "k0", 2.0))
    got = held(spark, tree)
    assert got == {k: descend(k, tree) for k in got}
    share = Counter(got.values())
    for shard in range(7):
        want = KEYS * (2 if shard == 6 else 1) / 8
        assert abs(share[shard] - want) < 5 * math.sqrt(want)


def test_growth_moves_rows_only_into_what_grew(spark):
    tree = even_tree(8)
    for step in range(3):
        grown = add_weight(tree, 8 + step)
        a, b = held(spark, tree), held(spark, grown)
        moved = [k for k in a if a[k] != b[k]]
        assert moved and all(b[k] == 8 + step for k in moved)
        want = KEYS / (9 + step)
        assert abs(len(moved) - want) < 5 * math.sqrt(want)
        tree = grown
    heavier = add_weight(tree, 2, 1.5)
    a, b = held(spark, tree), held(spark, heavier)
    assert any(a[k] != b[k] for k in a) and all(b[k] == 2 for k in a if a[k] != b[k])


def test_less_weight_moves_rows_only_out_of_the_subtree(spark):
    tree = even_tree(8)
    where = {leaf.shard: leaf.region for leaf in tree}
    for factor in (0.5, 0.0):
        a, b = held(spark, tree), held(spark, set_weight(tree, 3, factor))
        moved = [k for k in a if a[k] != b[k]]
        assert moved and all(where[a[k]] == where[3] for k in moved)
        assert all(b[k] != 3 for k in a if a[k] != 3)
    with pytest.raises(ValueError):
        set_weight(tree, 3, 2.0)
    with pytest.raises(ValueError):
        hash_tree.children(())


def test_slots_of_odd_rows(spark):
    rows = [(None, "x", 1)] * 400 + [(5, None, 1), (5, "", 2), (5, "é", 3), (5, "é", 3), (None, None, 0)] + [(i, "word " * (i % 7), i) for i in range(300)]
    rows += [(900, "long " * 200_000, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(7)
    tree = even_tree(8)
    got = hash_tree.place(frame, tree, add_weight(tree, 8)).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    by_shard: dict = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1 and len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert hash_tree.place(frame.limit(0), tree, tree).count() == 0
    whole, name = hash_tree.with_shard(frame, tree)
    assert name == "_shard" and whole.columns == [*frame.columns, "_shard"]
