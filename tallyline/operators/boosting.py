"""Gradient-boosted trees with missing values and monotone inputs, grown from histograms that Spark adds up.

Inputs are cut at quantiles into at most 255 bins, bin 0 for missing values, and
written once as one byte string per row. A tree grows level by level: each task
sums gradients and curvatures of its rows per (open node, input, bin), a keyed
aggregation adds the tasks' cells, and the driver, which sees only nodes times
inputs times bins, chooses the splits: the cut, and the side missing values go
to. Sums are of integers (gradients in steps of 2^-20), so they are exact and a
tree does not depend on how rows are dealt; of two siblings only the one with
fewer rows is summed, the other is what is left of their parent.

An input can be held monotone: a split must order its sides' values, and the
bound between them (their mean) holds for everything below, so the whole model is
monotone in it. Growth stops early when the loss on held-out rows has not
improved for ``patience`` rounds; that loss comes with the first level's pass.

Rows whose label is null are left out. An input without values has one bin.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BINS = 255
UNIT = float(1 << 20)
# trees after which the rows' margins are written anew, and trees after which the sum of the values since then is
REWRITE = 16
CARRY = 4


@dataclass
class Settings:
    rounds: int = 500
    step: float = 0.06
    depth: int = 5
    least_rows: int = 200
    l2: float = 2.0
    patience: int = 10
    monotone: dict[str, int] = field(default_factory=dict)


class Tree:
    """A binary tree stored as a heap: children of node k are 2k + 1 and 2k + 2; input -1 is a leaf."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.depth = depth
        self.input, self.cut = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.missing_left, self.value = np.zeros(n, bool), np.zeros(n)

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth if levels is None else levels):
            f = self.input[at]
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == 0, self.missing_left[at], b <= self.cut[at])
            at = np.where(f >= 0, 2 * at + 2 - left, at)
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of a table of doubles: 0 for missing, else 1 + the number of edges below the value."""
    out = np.zeros(values.shape, np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(values[:, j])
        out[known, j] = 1 + np.searchsorted(e, values[known, j], "left")
    return out


@dataclass
class Split:
    gain: float
    input: int = -1
    cut: int = 0
    missing_left: bool = False
    left: float = 0.0
    right: float = 0.0


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, signs: list[int], low: float, high: float, s: Settings) -> Split:
    """The best split of a node from its sums per (input, bin); values stay within ``low`` and ``high``."""

    def value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.clip(-a / (b + s.l2), low, high)

    def loss(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        return a * v + 0.5 * (b + s.l2) * v * v

    total = g[0].sum(), h[0].sum(), n[0].sum()
    own = loss(*total[:2], value(*total[:2]))
    best = Split(1e-9)
    for missing_left in (False, True):
        sums = [np.cumsum(x[:, 1:], axis=1)[:, :-1] + (x[:, :1] if missing_left else 0) for x in (g, h, n)]
        rest = [t - x for t, x in zip(total, sums, strict=True)]
        left, right = value(sums[0], sums[1]), value(rest[0], rest[1])
        gain = own - loss(sums[0], sums[1], left) - loss(rest[0], rest[1], right)
        gain[(sums[2] < s.least_rows) | (rest[2] < s.least_rows)] = -math.inf
        for j, sign in enumerate(signs):
            if sign:
                gain[j, sign * (right[j] - left[j]) < 0] = -math.inf
        if gain.size and gain.max() > best.gain:
            j, b = np.unravel_index(int(gain.argmax()), gain.shape)
            best = Split(float(gain[j, b]), int(j), int(b) + 1, missing_left, float(left[j, b]), float(right[j, b]))
    return best


class Booster:
    """Bin edges, first value and trees."""

    def __init__(self, features: list[str], edges: list[np.ndarray], start: float, trees: list[Tree]):
        self.features, self.edges, self.start, self.trees = features, edges, start, trees

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.edges)
        return self.start + sum((t.values(bins) for t in self.trees), np.zeros(len(values)))

    def probability(self) -> Column:
        """The model's probability of a row, from its input columns."""

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
            return pd.Series(1 / (1 + np.exp(-self.margins(values))))

        return score(*[F.col(c).cast("double") for c in self.features])

    def to_json(self) -> str:
        trees = [{"depth": t.depth} | {k: getattr(t, k).tolist() for k in ("input", "cut", "missing_left", "value")} for t in self.trees]
        return json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges], "start": self.start, "trees": trees})

    @staticmethod
    def from_json(text: str) -> Booster:
        said = json.loads(text)
        trees = []
        for t in said["trees"]:
            made = Tree(t["depth"])
            made.input, made.cut = np.array(t["input"], np.int32), np.array(t["cut"], np.int32)
            made.missing_left, made.value = np.array(t["missing_left"], bool), np.array(t["value"])
            trees.append(made)
        return Booster(said["features"], [np.array(e) for e in said["edges"]], said["start"], trees)


def quantile_edges(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """At most 254 cuts per input, from one aggregation."""
    shares = [i / BINS for i in range(1, BINS)]
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    row = df.agg(*[F.percentile_approx(value(c), shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(row[f"q{i}"] or [], np.float64)) for i in range(len(features))]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = int(ends[column.offset]), int(ends[column.offset + len(column)])
    return np.frombuffer(data, np.uint8)[first:last].reshape(-1, width)


def _histogram(rows: DataFrame, width: int, recent: list[Tree], tree: Tree, open_nodes: list[int], level: int) -> dict[int, tuple[int, int, int]]:
    """Cell -> sums over the training rows in the given nodes of a level; cell -1 holds the loss and number of held-out rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(open_nodes) * width * (BINS + 1)
        sums = [np.zeros(cells) for _ in range(3)]
        slot = np.full(len(tree.input), -1, np.int64)
        slot[open_nodes] = np.arange(len(open_nodes))
        lost = seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch.column(0), width)
            y, margin, added, held = (np.asarray(batch.column(i)) for i in (1, 2, 3, 4))
            margin = margin + sum((t.values(bins) for t in recent), added)
            if level == 0 and held.any():
                lost += int(np.rint(UNIT * (np.logaddexp(0, margin[held]) - y[held] * margin[held])).sum())
                seen += int(held.sum())
            p = 1 / (1 + np.exp(-margin))
            at = slot[tree.nodes(bins, level)]
            used = (at >= 0) & ~held
            cell = ((at[used, None] * width + np.arange(width)) * (BINS + 1) + bins[used]).ravel()
            for total, x in zip(sums, (np.rint(UNIT * (p - y)), np.rint(UNIT * p * (1 - p)), np.ones(len(y))), strict=True):
                total += np.bincount(cell, np.repeat(x[used], width), cells)
        at = np.flatnonzero(sums[2])
        names = ["cell", "g", "h", "n"]
        parts = [np.concatenate([[-1], at])] + [np.concatenate([[x], s[at]]) for x, s in zip((lost, 0, seen), sums, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in parts], names=names)

    made = rows.select("bins", "y", "margin", "added", "held").mapInArrow(run, "cell long, g long, h long, n long")
    # at most open nodes times inputs times bins rows
    return {r["cell"]: (r["g"], r["h"], r["n"]) for r in made.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()}


def _rewritten(rows: DataFrame, width: int, recent: list[Tree], whole: bool) -> DataFrame:
    """The rows with the values of the recent trees in ``added``, or, with all trees since the last margin, in ``margin``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, margin = _matrix(batch.column(0), width), np.asarray(batch.column(2))
                added = sum((t.values(bins) for t in recent), np.asarray(batch.column(3)))
                if whole:
                    margin, added = margin + added, np.zeros(len(bins))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(margin), pa.array(added), batch.column(4)], names=["bins", "y", "margin", "added", "held"]
                )

    return materialise(rows.mapInArrow(run, rows.schema), "boost-rows")


def grow(rows: DataFrame, features: list[str], recent: list[Tree], s: Settings) -> tuple[Tree, float | None]:
    """One tree on the rows as they stand, and the held-out loss before it."""
    width, tree = len(features), Tree(s.depth)
    signs = [s.monotone.get(c, 0) for c in features]
    bounds = {0: (-math.inf, math.inf)}
    open_nodes, counted, held = [0], [0], None
    tables: dict[int, np.ndarray] = {}
    for level in range(s.depth):
        sums = _histogram(rows, width, recent, tree, counted, level)
        lost = sums.pop(-1, (0, 0, 0))
        if level == 0 and lost[2]:
            held = lost[0] / UNIT / lost[2]
        table = np.zeros((3, len(counted) * width * (BINS + 1)))
        at = np.fromiter(sums, np.int64, len(sums))
        if len(at):
            table[:, at] = np.array(list(sums.values()), np.float64).T
        table = table.reshape(3, len(counted), width, BINS + 1)
        above, tables = tables, {node: table[:, i] for i, node in enumerate(counted)}
        for node in open_nodes:
            if node not in tables:  # children of k are 2k + 1 and 2k + 2
                tables[node] = above[(node - 1) // 2] - tables[node + 1 if node % 2 else node - 1]
        following, counted = [], []
        for node in open_nodes:
            g, h, n = tables[node]
            g, h = g / UNIT, h / UNIT
            low, high = bounds[node]
            if level == 0:
                tree.value[0] = s.step * float(np.clip(-g[0].sum() / (h[0].sum() + s.l2), low, high))
            split = best_split(g, h, n, signs, low, high, s)
            if split.input < 0:
                continue
            tree.input[node], tree.cut[node], tree.missing_left[node] = split.input, split.cut, split.missing_left
            a, b = 2 * node + 1, 2 * node + 2
            tree.value[a], tree.value[b] = s.step * split.left, s.step * split.right
            middle, sign = (split.left + split.right) / 2, signs[split.input]
            bounds[a] = (low, middle) if sign > 0 else (middle, high) if sign < 0 else (low, high)
            bounds[b] = (middle, high) if sign > 0 else (low, middle) if sign < 0 else (low, high)
            following += [a, b]
            taken = n[split.input]
            left = taken[1 : split.cut + 1].sum() + (taken[0] if split.missing_left else 0)
            counted.append(a if 2 * left <= taken.sum() else b)
        open_nodes = following
        if not open_nodes:
            break
    return tree, held


def fit(train: DataFrame, features: list[str], label: str = "y", settings: Settings | None = None, held_out: Column | None = None) -> Booster:
    """Fit on all rows but those where ``held_out`` is true, which tell when to stop (none: all rounds are grown)."""
    s = settings or Settings()
    known = train.filter(F.col(label).isNotNull())
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    slim = materialise(known.select(F.col(label).cast("double").alias("y"), held.alias("held"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]), "boost-input")
    names = [f"f{i}" for i in range(len(features))]
    edges = quantile_edges(slim.filter(~F.col("held")), names)
    share = slim.filter(~F.col("held")).agg(F.avg("y").alias("share")).first()["share"]
    share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
    start = math.log(share / (1 - share))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[2:]])
                bins = [r.tobytes() for r in binned(values, edges)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bins, pa.binary()), batch.column(0), pa.array(np.full(len(bins), start)), pa.array(np.zeros(len(bins))), batch.column(1)],
                    names=["bins", "y", "margin", "added", "held"],
                )

    rows = materialise(slim.select("y", "held", *names).mapInArrow(cut, "bins binary, y double, margin double, added double, held boolean"), "boost-rows")
    trees: list[Tree] = []
    recent: list[Tree] = []
    best, best_at = math.inf, 0
    for done in range(s.rounds + (held_out is not None)):
        tree, loss = grow(rows, features, recent, s)
        if loss is not None:
            if loss < best - 1e-7:
                best, best_at = loss, done
            if done - best_at >= s.patience or done == s.rounds:
                return Booster(features, edges, start, trees[:best_at])
        if tree.input[0] < 0:  # nothing left to split
            break
        trees.append(tree)
        recent.append(tree)
        if len(recent) == CARRY:
            rows, recent = _rewritten(rows, len(features), recent, len(trees) % REWRITE == 0), []
    return Booster(features, edges, start, trees if math.isinf(best) else trees[:best_at] if best_at else trees)
