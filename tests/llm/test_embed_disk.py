"""Embedding near-duplicates: what is written and shuffled follows the input, not the pairs of leaves."""

from __future__ import annotations

import os
import threading

import numpy as np
import pytest

from tallyline.llm import embed_dedup
from tallyline.llm.shared import ship
from tallyline.session import shared_folder
from tests.llm.test_dense_cores import plain_links


def most_on_disk(spark, run):
    """What ``run`` gives, and how far shuffles and the shared folder grew meanwhile, in bytes."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    tops = [*(f.getPath() for f in local), shared_folder(spark).removeprefix("file:")]

    def now() -> int:
        total = 0
        for top in tops:
            for folder, _, files in os.walk(top):
                for file in files:
                    try:
                        total += os.path.getsize(os.path.join(folder, file))
                    except FileNotFoundError:  # cleaned up meanwhile
                        pass
        return total

    before, seen, ended = now(), [0], threading.Event()

    def watch():
        while not ended.wait(0.02):
            seen.append(now())

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        out = run()
        return out, max([*seen, now()]) - before
    finally:
        ended.set()
        watcher.join()


def scattered(n: int, seed: int = 3) -> np.ndarray:
    """Directions without structure, an eighth of them near copies of others."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 64))
    v[: n // 8] = v[n // 8 : n // 8 * 2] + rng.normal(size=(n // 8, 64)) * 0.2
    return v.astype(np.float32)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_disk_follows_the_input(spark, kind):
    ship(spark)
    v = scattered(4000)
    frame = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], f"vec_id long, label int, embedding array<{kind}>")
    rows, used = most_on_disk(spark, lambda: embed_dedup.near_duplicates(frame, leaf=64).collect())
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}
    links, name = plain_links(v.astype(float), 0.93)
    assert got == {i: (links[i], name[i]) for i in range(len(v))}
    # all pairs of leaves hold each vector about 60 times
    assert used < 10 * v.astype(kind if kind == "double" else np.float32).nbytes


def test_roots_of_many_leaves_share_buckets(spark, monkeypatch):
    """Several large labels, an id in two of them, lengths that differ, equal vectors, compared in more than one job."""
    ship(spark)
    monkeypatch.setattr(embed_dedup, "BUCKET", 60_000)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for label in range(4):
        v = scattered(300, label)
        v[290:] = v[289]
        ids = [label * 1000 + i for i in range(300)]
        rows += [(i, label, x.tolist()) for i, x in zip(ids, v, strict=True)]
        links, name = plain_links(v.astype(float), 0.93)
        want |= {i: (links[k], ids[name[k]]) for k, i in enumerate(ids)}
    rows += [(9000 + i, 2, rng.normal(size=8).tolist()) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    short = {9000 + i: embed_dedup.near_duplicates(frame.filter("vec_id >= 9000")).filter(f"vec_id = {9000 + i}").first() for i in range(1)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(frame, leaf=32).collect()}
    assert {k: x for k, x in got.items() if k < 9000} == want
    assert got[9000] == (short[9000]["n_links"], short[9000]["component_id"])


def test_an_id_of_two_labels_joins_their_components(spark):
    ship(spark)
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, 1, x), (3, 1, [1.0, 0.01, 0.0]), (7, 2, y), (5, 2, [0.01, 1.0, 0.0]), (9, 2, [0.0, 0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(frame).collect())
    # partners are counted per id
    assert got == [(3, 1, 3), (5, 1, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9)]


def test_products_and_trees_of_unlike_depth_find_the_same_pairs():
    rng = np.random.default_rng(8)
    centres = embed_dedup.unit(rng.normal(size=(12, 64)))
    loose = embed_dedup.unit(rng.normal(size=(400, 64)))
    tight = embed_dedup.unit(centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 64)) * 0.02)
    loose[:50] = embed_dedup.unit(tight[:50] + rng.normal(size=(50, 64)) * 0.04)
    one, other = embed_dedup.Tree(loose), embed_dedup.Tree(tight)
    assert len(one.nets) != len(other.nets)
    for a, b in ((one, other), (other, one), (one, one), (other, other)):
        for threshold in (0.5, 0.93, 0.999):
            want = set(zip(*(k.tolist() for k in np.nonzero(a.vectors @ b.vectors.T >= threshold)), strict=True))
            for how in (embed_dedup.linked, embed_dedup._product):
                assert set(zip(*(k.tolist() for k in how(a, b, threshold)), strict=True)) == want


def test_equal_vectors_get_equal_cells_in_any_batch():
    rng = np.random.default_rng(1)
    u = embed_dedup.unit(rng.normal(size=(2000, 64)))
    centres = np.rint(embed_dedup.unit(rng.normal(size=(300, 64))) * embed_dedup.GRID)
    whole = np.rint(u * embed_dedup.GRID) @ centres.T
    for at in range(0, 2000, 37):
        assert np.array_equal(whole[at : at + 37], np.rint(u[at : at + 37] * embed_dedup.GRID) @ centres.T)
