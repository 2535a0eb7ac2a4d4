"""Embedding near-duplicates where the data are a dense core with a heavy-tailed spread."""

from __future__ import annotations

import numpy as np
import pytest

from tallyline.llm import embed_dedup
from tallyline.llm.shared import ship


def plain_links(v: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    name = np.arange(len(v))
    while True:
        least = np.minimum(name, np.where(near, name[None, :], len(v)).min(axis=1))
        if (least == name).all():
            return near.sum(axis=1).tolist(), name.tolist()
        name = least


def heavy(seed: int, n: int, size: int, tail: float) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(size=size) + rng.normal(size=(n, size)) * 0.02 * rng.pareto(tail, (n, 1))


@pytest.mark.parametrize(("n", "tail", "leaf"), [(5000, 0.5, 1024), (1500, 0.3, 64), (1500, 2.0, 64)])
def test_dense_core_with_outliers(spark, n, tail, leaf):
    ship(spark)
    v = heavy(7, n, 64, tail)
    frame = spark.createDataFrame([(i * 64, 1, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    links, name = plain_links(v, 0.93)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(frame, leaf=leaf).collect()}
    assert got == {i * 64: (links[i], name[i] * 64) for i in range(n)}


def test_written_trees_find_the_same_pairs():
    rng = np.random.default_rng(2)
    centres = embed_dedup.unit(rng.normal(size=(40, 6)))
    a, b = (embed_dedup.unit(centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, 6)) * 0.05) for _ in range(2))
    trees = [embed_dedup.Tree.read(embed_dedup.Tree(x).written(), x) for x in (a, b)]
    for threshold in (0.93, 0.999):
        want = set(zip(*(k.tolist() for k in np.nonzero(a @ b.T >= threshold)), strict=True))
        assert set(zip(*(k.tolist() for k in embed_dedup.linked(*trees, threshold)), strict=True)) == want
