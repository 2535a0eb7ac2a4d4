"""Boosted trees against splits tried one by one, and their guarantees."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import boosting
from tallyline.operators.boosting import Booster, Settings

SCHEMA = "y long, a double, b double, c double"


def rows(n, seed=3):
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = None if rng.random() < 0.2 else rng.choice([float(rng.randint(0, 9)), rng.random() * 10])
        b, c = rng.random(), float(rng.randint(0, 3))
        z = (2.0 if a is None else 0.4 * (a - 5)) + 3 * (b - 0.5) ** 2 + rng.gauss(0, 1)
        out.append((int(z > 0.3), a, b, c))
    return out


def plain_tree(data, s, signs):
    """All splits of all nodes tried one by one on the values themselves; predictions of the rows."""
    share = sum(r[0] for r in data) / len(data)
    p = share
    unit = boosting.UNIT
    g = [round((p - r[0]) * unit) / unit for r in data]
    h = [round(p * (1 - p) * unit) / unit for r in data]
    out = [0.0] * len(data)

    def best_value(idx, low, high):
        return min(max(-sum(g[i] for i in idx) / (sum(h[i] for i in idx) + s.l2), low), high)

    def loss(idx, v):
        return sum(g[i] for i in idx) * v + 0.5 * (sum(h[i] for i in idx) + s.l2) * v * v

    def walk(idx, depth, low, high, value):
        found = None
        if depth < s.depth:
            own = loss(idx, best_value(idx, low, high))
            for missing_left in (False, True):
                for j in range(3):
                    for cut in sorted({data[i][1 + j] for i in range(len(data)) if data[i][1 + j] is not None})[:-1]:
                        left = [i for i in idx if (missing_left if data[i][1 + j] is None else data[i][1 + j] <= cut)]
                        right = [i for i in idx if i not in set(left)]
                        if min(len(left), len(right)) < s.least_rows:
                            continue
                        vl, vr = best_value(left, low, high), best_value(right, low, high)
                        if signs[j] and signs[j] * (vr - vl) < 0:
                            continue
                        gain = own - loss(left, vl) - loss(right, vr)
                        if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                            found = (gain, left, right, vl, vr, signs[j])
        if found is None:
            for i in idx:
                out[i] = value * s.step
            return
        _, left, right, vl, vr, sign = found
        mid = (vl + vr) / 2
        walk(left, depth + 1, mid if sign < 0 else low, mid if sign > 0 else high, vl)
        walk(right, depth + 1, mid if sign > 0 else low, mid if sign < 0 else high, vr)

    walk(list(range(len(data))), 0, -math.inf, math.inf, best_value(range(len(data)), -math.inf, math.inf))
    return [math.log(share / (1 - share)) + v for v in out]


def values(data):
    return np.array([[math.nan if v is None else v for v in r[1:]] for r in data])


@pytest.mark.parametrize("sign", [0, 1, -1])
def test_first_tree_equals_splits_tried_one_by_one(spark, sign):
    data = rows(110)
    s = Settings(rounds=1, depth=3, least_rows=5, l2=1.0, monotone={"a": sign})
    made = boosting.fit(spark.createDataFrame(data, SCHEMA).repartition(5), ["a", "b", "c"], settings=s)
    assert made.margins(values(data)) == pytest.approx(plain_tree(data, s, [sign, 0, 0]), abs=1e-9)


def test_model_learns_is_monotone_and_does_not_depend_on_partitions(spark):
    data = rows(3000)
    s = Settings(rounds=20, depth=3, least_rows=20, step=0.3, monotone={"a": 1})
    frame = spark.createDataFrame(data, SCHEMA)
    fits = [boosting.fit(frame.repartition(n), ["a", "b", "c"], settings=s) for n in (1, 7)]
    assert fits[0].to_json() == fits[1].to_json() and len(fits[0].trees) == 20
    grid = np.array([[a, b, c] for b in np.linspace(0, 1, 12) for c in range(4) for a in np.linspace(-1, 11, 60)])
    made = fits[0].margins(grid).reshape(-1, 60)
    assert (np.diff(made, axis=1) >= 0).all() and np.ptp(made) > 1
    y = np.array([r[0] for r in data])
    m = fits[0].margins(values(data))
    loss = np.mean(np.logaddexp(0, m) - y * m)
    base = -np.mean(y) * math.log(np.mean(y)) - (1 - np.mean(y)) * math.log(1 - np.mean(y))
    assert loss < 0.8 * base
    # missing values go where they belong: they win most of the time here
    assert fits[0].margins(np.array([[math.nan, 0.5, 1.0]]))[0] > fits[0].margins(np.array([[0.0, 0.5, 1.0]]))[0]
    again = Booster.from_json(fits[0].to_json())
    p = [r[0] for r in frame.select(again.probability()).collect()]
    assert p == pytest.approx((1 / (1 + np.exp(-m))).tolist(), abs=1e-12)


def test_growth_stops_when_held_out_rows_gain_nothing(spark):
    rng = random.Random(1)
    noise = [(rng.randint(0, 1), rng.random(), rng.random(), None) for _ in range(600)]
    frame = spark.createDataFrame([(*r, i % 4 == 0) for i, r in enumerate(noise)], SCHEMA + ", held boolean")
    s = Settings(rounds=60, depth=2, least_rows=10, step=0.5, patience=3)
    made = boosting.fit(frame, ["a", "b", "c"], settings=s, held_out=F.col("held"))
    assert len(made.trees) < 20
    assert boosting.fit(frame.filter("y > 5"), ["a", "b", "c"], settings=s).trees == []


def test_only_one_of_two_siblings_is_summed(spark, monkeypatch):
    summed, made = [], boosting._histogram

    def keep(rows, width, recent, tree, nodes, level):
        summed.append(list(nodes))
        return made(rows, width, recent, tree, nodes, level)

    monkeypatch.setattr(boosting, "_histogram", keep)
    s = Settings(rounds=6, depth=3, least_rows=20, step=0.3)
    fitted = boosting.fit(spark.createDataFrame(rows(600), SCHEMA), ["a", "b", "c"], settings=s)
    assert len(fitted.trees) == 6 and max(len(n) for n in summed) > 1
    assert all(len({(k - 1) // 2 for k in nodes}) == len(nodes) for nodes in summed)
