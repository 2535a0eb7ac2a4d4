"""Embedding near-duplicates by dual traversal of trees over a routed table.

Vectors are compared on the unit sphere, where a cosine of at least c is a
chord of at most ``sqrt(2 - 2c)``. Vectors of one label and length are a root.
A root of more than ``LEAF`` vectors is cut into cells by nearest centre; the
centres come from a bounded sample (half of them farthest first, so that far
parts get one, the others in hash order, so that dense parts get several), as
many as the sample says will pay. A cell of many leaves is dealt by hash first.
A group of points that arrives in one task is halved along its widest line into
leaves of at most ``LEAF`` points. Centre and covering radius of a leaf are
measured over all its points, so bounds never rest on the sample; centres only
decide how well they prune. Inside a leaf, nested nets with halving radii (1,
1/2, 1/4, 1/8, as long as they hold less than half the points) continue the
tree, built once per leaf.

A pair of leaves whose centres are farther apart than both covering radii and
the threshold chord is dropped. The trees of the others are traversed together:
pairs of nodes that the bounds rule out are dropped, others replaced by the
pairs of their children, and at last points, whose cosine is computed in double
precision and compared with the threshold. Where bounds prune too little to
pay, the points are compared as matrix products in single precision: first of
their leading numbers and the length of the others, which bounds the cosine, and
of all numbers where that rules out too little. What is within the rounding of
the threshold, or above the bound alone, is computed in double precision.

Disk follows the input. Vectors are shuffled once, to their cell, in the
precision of the input, and written once, as leaves. Pairs of leaves are never
written or shuffled: each task of a cartesian product reads two parts of the
leaves and compares them. Roots are compared in buckets of about ``BUCKET``
bytes, so that parts of different roots seldom meet.

Equal vectors of a label are one point with a weight. A leaf is compared with
itself when it is made and keeps a root for each of its local components; a task
that compares leaves returns how many rows each point is linked to and a
spanning forest of the links between those roots, never all pairs. Components of
the links are found over these roots.

The input is read twice; one that gives other rows the second time raises an
error and has to be written first.

Rows whose label or vec_id is null, or whose vector is null, empty, zero or
holds a null or non-finite number, link with nothing: no links, a component of
their own (``component_id = vec_id``). Vectors of different length are never
compared. Repeated rows count as vectors of their own. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, scratch_path
from .arrays import ragged
from .shared import components, remove_folder

THRESHOLD = 0.93
LEAF = 1024
# bytes of sampled vectors that centres are chosen from, over all roots
SAMPLE = 16 << 20
# centres of one root
FAN = 2048
# a cell of more leaves than this is dealt by hash first
DEAL = 16
# bytes of vectors whose leaves are compared by one job
BUCKET = 256 << 20
# bytes of vectors of the two parts that a task compares
LEFT, RIGHT = 64 << 20, 16 << 20
# bytes of trees a task keeps
KEEP = 96 << 20
# node pairs cost this many times a pair inside a matrix product
GATHER = 32
# points of a leaf in one product
BLOCK = 256
# a pair of leaves costs as much as this many pairs inside a matrix product
PAIR = 400_000
# chords below this are rounding
FINEST = 1e-6
NETS = (1.0, 0.5, 0.25, 0.125)
# bounds are compared with this much room for rounding; the last comparison is exact
SLACK = 1e-9
# directions are rounded to this for routing: sums of their products are whole numbers, exact in any order
GRID = float(1 << 20)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    # scaled first, so that no square overflows or vanishes
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


# ---- points


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Places of the rows of ``(label, vec_id, vector)`` that can link, their vectors as bytes, their labels and 128-bit names."""
    labels, ids, column = batch.column(0), batch.column(1), batch.column(2)
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    from_, to = offsets[:-1], offsets[1:]
    ok = labels.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False)
    # a null number is read as NaN
    bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
    at = np.flatnonzero(ok & (bad[to] == bad[from_]) & (some[to] > some[from_]))
    blobs = [values[a:b].tobytes() for a, b in zip(from_[at].tolist(), to[at].tolist(), strict=True)]
    label = labels.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[at]
    digests = [hashlib.blake2b(blob, digest_size=16, key=k.tobytes()).digest() for k, blob in zip(label, blobs, strict=True)]
    return at, blobs, label, np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


_NAMED = "vec_id long, label long, size int, h1 long, h2 long, sample binary"


def _named(total: int):
    """All rows with root and name, null where they link with nothing; the vector where the name falls into the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, blobs, label, names = _usable(batch)
            size = np.fromiter(map(len, blobs), np.int64, len(blobs))
            share = np.minimum(1.0, SAMPLE / (total * np.maximum(size, 1)))
            chosen = (names[:, 0].view(np.uint64) / 2.0**64 < share).tolist()
            null = np.ones(batch.num_rows, bool)
            null[at] = False
            where = np.zeros(batch.num_rows, np.int64)
            where[at] = np.arange(len(at))
            where = pa.array(where, mask=null)
            columns = [pa.array(label), pa.array(size, pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([b if c else None for b, c in zip(blobs, chosen, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), *[c.take(where) for c in columns]], names=["vec_id", "label", "size", "h1", "h2", "sample"])

    return run


def _matrix(blobs: list[bytes], double: bool) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64 if double else np.float32).reshape(len(blobs), -1)


# ---- cells


_ROUTES = "label long, size int, n long, centres binary, pieces binary"


def _routes(leaf: int, chord: float, double: bool):
    """From a root's sample: centres of cells, on the grid, and the number of pieces each cell is dealt into."""

    def nearest(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, least = np.empty(len(u), np.int64), np.empty(len(u))
        for at in range(0, len(u), 4096):
            d = chords(u[at : at + 4096], c)
            own[at : at + 4096] = d.argmin(axis=1)
            least[at : at + 4096] = d.min(axis=1)
        return own, least

    def cost(u: np.ndarray, chosen: list[int], n: int) -> float:
        """Of comparing the cells that bounds would leave, in pairs inside a product."""
        own, least = nearest(u, u[chosen])
        radius, count = np.zeros(len(chosen)), np.bincount(own, minlength=len(chosen)) * (n / len(u))
        np.maximum.at(radius, own, least)
        near = chords(u[chosen], u[chosen]) <= radius[:, None] + radius[None, :] + chord
        leaves = np.ceil(count / leaf)
        return float(count @ near @ count + PAIR * (leaves @ near @ leaves))

    def run(table: pa.Table) -> pa.Table:
        label, size, n = (table.column(c)[0].as_py() for c in ("label", "size", "n"))
        order = np.lexsort([table.column(c).to_numpy() for c in ("h2", "h1")])
        u = unit(_matrix(table.column("sample").to_pylist(), double)[order])
        most = max(1, min(FAN, len(u) // 3, 8 * n // leaf))
        # farthest first, until what is left is closer than bounds can tell
        far, least = [0], chords(u[:1], u)[0]
        while len(far) < most and least.max() > max(chord / 2, FINEST):
            far.append(int(least.argmax()))
            least = np.minimum(least, chords(u[far[-1:]], u)[0])
        plans = []
        for k in {most, max(1, min(most, 2 * n // leaf)), 1}:
            chosen = far[: max(1, k // 2)] if k < most else far
            seen = set(chosen)
            chosen = chosen + [i for i in range(len(u)) if i not in seen][: k - len(chosen)]
            plans.append((cost(u, chosen, n), k, chosen))
        chosen = min(plans)[2]
        own, _ = nearest(u, u[chosen])
        pieces = -(-np.bincount(own, minlength=len(chosen)) * n // (len(u) * DEAL * leaf))
        row = {"label": label, "size": size, "n": n, "centres": np.rint(u[chosen] * GRID).astype(np.int32).tobytes(), "pieces": np.maximum(pieces, 1).astype(np.int64).tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("label", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("centres", pa.binary()), ("pieces", pa.binary())]))

    return run


_POINTS = "label long, size int, cell int, piece long, h1 long, h2 long, vec_id long, weight long, vector binary"


def _routed(sent, double: bool):
    """Each usable vector with its cell; equal vectors of a batch are one point. Equal vectors get equal cells wherever they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = sent.value
        for batch in batches:
            at, blobs, label, names = _usable(batch)
            if not len(at):
                continue
            ids = batch.column(1).take(pa.array(at)).to_numpy()
            first, weight, ids = _distinct(names, ids, np.ones(len(at), np.int64))
            blobs, label, names = [blobs[i] for i in first.tolist()], label[first], names[first]
            size = np.fromiter(map(len, blobs), np.int64, len(blobs))
            cell, piece = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            roots, which = np.unique(np.stack([label, size], axis=1), axis=0, return_inverse=True)
            which = which.reshape(-1)
            for r, root in enumerate(roots.tolist()):
                if tuple(root) in routes:
                    centres, pieces = routes[tuple(root)]
                    mine = np.flatnonzero(which == r)
                    u = np.rint(unit(_matrix([blobs[i] for i in mine.tolist()], double)) * GRID)
                    cell[mine] = (u @ centres.T).argmax(axis=1)
                    piece[mine] = (names[mine, 1].view(np.uint64) % pieces[cell[mine]].astype(np.uint64)).astype(np.int64)
            columns = [label, size.astype(np.int32), cell.astype(np.int32), piece, names[:, 0], names[:, 1], ids, weight]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(blobs, pa.binary())], names=["label", "size", "cell", "piece", "h1", "h2", "vec_id", "weight", "vector"])

    return run


def _distinct(names: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each different name is found, with its weight and least id."""
    order = np.lexsort([ids, names[:, 1], names[:, 0]])
    new = np.flatnonzero(np.concatenate([[True], (names[order[1:]] != names[order[:-1]]).any(axis=1)]))
    return order[new], np.add.reduceat(weights[order], new), ids[order[new]]


# ---- trees inside leaves


class Tree:
    """Nested nets over a leaf: at each level a centre per node, its covering radius, its children on the next level."""

    @classmethod
    def read(cls, made: bytes, vectors: np.ndarray) -> Tree:
        """A tree that ``written`` gave, over the same vectors."""
        tree = cls.__new__(cls)
        tree.vectors, tree.small, tree.head = vectors, vectors.astype(np.float32), None
        nets, tree.radii, child_at, children = pickle.loads(made)
        points = np.arange(len(vectors))
        # points are their own children: the other tree may have more levels
        tree.nets, tree.radii = [*nets, points], [*tree.radii, np.zeros(len(vectors))]
        tree.child_at, tree.children = [*child_at, np.arange(len(vectors) + 1)], [*children, points]
        return tree

    def written(self) -> bytes:
        whole = [[x.astype(np.int32) for x in part[:-1]] for part in (self.nets, self.child_at, self.children)]
        return pickle.dumps((whole[0], self.radii[:-1], whole[1], whole[2]))

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.small, self.head = vectors, vectors.astype(np.float32), None
        n = len(vectors)
        d = chords(vectors, vectors)
        owner = np.zeros(n, np.int64)
        nets = [np.zeros(1, np.int64)]
        owners = [owner]
        for radius in NETS:
            kept = list(nets[-1])
            least = d[kept].min(axis=0)
            while least.max() > radius and 2 * len(kept) <= n:
                i = int((least > radius).argmax())
                kept.append(i)
                least = np.minimum(least, d[i])
            if 2 * len(kept) > n:
                # a level of nearly all points prunes no more than the points themselves
                break
            net = np.array(kept)
            # nearest centre among those whose parent is the point's own, so that nodes nest
            own = np.where(owners[-1][:, None] == owners[-1][net][None, :], d[:, net], np.inf).argmin(axis=1)
            nets.append(net)
            owners.append(net[own])
        nets.append(np.arange(n))
        owners.append(np.arange(n))
        self.nets, self.radii, self.child_at, self.children = nets, [], [], []
        for level, (net, owner) in enumerate(zip(nets, owners, strict=True)):
            radius = np.zeros(n)
            np.maximum.at(radius, owner, d[np.arange(n), owner])
            self.radii.append(radius[net])
            if level + 1 < len(nets):
                parent = np.searchsorted(np.sort(net), owner[nets[level + 1]])
                parent = np.argsort(net)[parent]
                order = np.argsort(parent, kind="stable")
                self.children.append(order)
                self.child_at.append(np.searchsorted(parent[order], np.arange(len(net) + 1)))
        self.radii[-1][:] = 0
        self.children.append(np.arange(n))
        self.child_at.append(np.arange(n + 1))


def linked(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of points (of a, of b) with cosine at least ``threshold``, by descending both trees together."""
    chord = float(np.sqrt(2 - 2 * threshold))
    i = j = np.zeros(1, np.int64)
    last_a, last_b = len(a.nets) - 1, len(b.nets) - 1
    for level in range(max(last_a, last_b)):
        at_a, at_b = min(level, last_a), min(level, last_b)
        x, y = a.vectors[a.nets[at_a][i]], b.vectors[b.nets[at_b][j]]
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (x * y).sum(axis=1)))
        near = apart <= a.radii[at_a][i] + b.radii[at_b][j] + chord + SLACK
        i, j = i[near], j[near]
        n_a = np.diff(a.child_at[at_a])[i]
        n_b = np.diff(b.child_at[at_b])[j]
        if GATHER * int((n_a * n_b).sum()) > len(a.vectors) * len(b.vectors):
            # the pairs left are not few: at most leaf x leaf cosines at once
            return _product(a, b, threshold)
        left = ragged(a.child_at[at_a][i], n_a)
        repeat = np.repeat(n_b, n_a)
        right = ragged(np.repeat(b.child_at[at_b][j], n_a), repeat)
        i, j = a.children[at_a][np.repeat(left, repeat)], b.children[at_b][right]
    near = (a.vectors[i] * b.vectors[j]).sum(axis=1) >= threshold
    return i[near], j[near]


def _head(tree: Tree, threshold: float) -> np.ndarray | None:
    """The first numbers of each point and the length of the others, whose products are no less than the cosines; as many as suit even directions."""
    k = math.ceil((2 + math.sqrt(4 + (1 - threshold) * tree.vectors.shape[1])) ** 2)
    if 2 * k > tree.vectors.shape[1]:
        return None
    if tree.head is None:
        rest = np.sqrt((tree.vectors[:, k:] ** 2).sum(axis=1, keepdims=True))
        tree.head = np.concatenate([tree.vectors[:, :k], rest], axis=1).astype(np.float32)
    return tree.head


def _product(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All close pairs by blocked products in single precision; what its rounding leaves open is computed in double."""
    # what single precision may lose
    doubt = 1.2e-7 * (a.small.shape[1] + 8)
    head_a, head_b = _head(a, threshold), _head(b, threshold)
    found = [(np.zeros(0, np.int64),) * 2]
    for at in range(0, len(a.small), BLOCK):
        few = head_a is not None
        if few:
            got = np.flatnonzero((head_a[at : at + BLOCK] @ head_b.T).ravel() >= threshold - doubt)
            few = GATHER * len(got) <= BLOCK * len(b.small)
        if few:
            open_ = np.arange(len(got))
        else:
            cosine = (a.small[at : at + BLOCK] @ b.small.T).ravel()
            got = np.flatnonzero(cosine >= threshold - doubt)
            open_ = np.flatnonzero(cosine[got] < threshold + doubt)
        if not len(got):
            continue
        i, j = np.divmod(got, len(b.small))
        i += at
        near = np.ones(len(got), bool)
        near[open_] = (a.vectors[i[open_]] * b.vectors[j[open_]]).sum(axis=1) >= threshold
        found.append((i[near], j[near]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        # everything points to its least neighbour, links inside what came together are dropped
        low = np.arange(n)
        np.minimum.at(low, a, b)
        np.minimum.at(low, b, a)
        while not np.array_equal(low, low[low]):
            low = low[low]
        root, a, b = low[root], low[a], low[b]
        a, b = a[a != b], b[a != b]
    return root


# ---- leaves


_LEAF = "bucket int, label long, size int, leaf string, centre array<double>, far double, ids binary, weights binary, names binary, roots binary, partners binary, tree binary, vectors binary"


def _halved(u: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the points in parts of at most ``most``, halved along the line between two far points."""
    done, open_ = [], [np.arange(len(u))]
    while open_:
        at = open_.pop()
        if len(at) <= most:
            done.append(at)
            continue
        one = u[at[(u[at] @ u[at[0]]).argmin()]]
        other = u[at[(u[at] @ one).argmin()]]
        order = at[np.argsort(u[at] @ (one - other), kind="stable")]
        open_ += [order[: len(at) // 2], order[len(at) // 2 :]]
    return done


def _leaves(sent, threshold: float, leaf: int, double: bool):
    """The leaves of the points that arrive together, each compared with itself."""

    def run(table: pa.Table) -> pa.Table:
        label, size, cell, piece = (table.column(c)[0].as_py() for c in ("label", "size", "cell", "piece"))
        names = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        first, weights, ids = _distinct(names, table.column("vec_id").to_numpy(), table.column("weight").to_numpy())
        raw, names = _matrix(table.column("vector").take(pa.array(first)).to_pylist(), double), names[first]
        u = unit(raw)
        parts = _halved(u, leaf)
        # a root that is one leaf meets no other
        bucket = sent.value.get((label, size), 1 if len(parts) > 1 else 0)
        rows = []
        for k, at in enumerate(parts):
            # by id, so that the least point of a component is its least id
            at = at[np.argsort(ids[at], kind="stable")]
            tree, weight = Tree(u[at]), weights[at]
            i, j = linked(tree, tree, threshold)
            i, j = i[i != j], j[i != j]
            partners = np.bincount(i, weights=weight[j], minlength=len(at)).astype(np.int64)
            centre = u[at].mean(axis=0)
            rows.append({
                "bucket": bucket, "label": label, "size": size, "leaf": f"{cell}.{piece}.{k}", "centre": centre.tolist(), "far": float(np.sqrt(((u[at] - centre) ** 2).sum(axis=1).max())),
                "ids": ids[at].tobytes(), "weights": weight.tobytes(), "names": names[at].tobytes(), "roots": ids[at][_least_reachable(len(at), i, j)].tobytes(), "partners": partners.tobytes(),
                "tree": tree.written(), "vectors": raw[at].tobytes(),
            })
        return pa.Table.from_pylist(rows, schema=_LEAF_ARROW)

    return run


_LEAF_ARROW = pa.schema([
    ("bucket", pa.int32()), ("label", pa.int64()), ("size", pa.int32()), ("leaf", pa.string()), ("centre", pa.list_(pa.float64())), ("far", pa.float64()),
    *[(c, pa.binary()) for c in ("ids", "weights", "names", "roots", "partners", "tree", "vectors")],
])


_POINT = "h1 long, h2 long, first long, weight long, partners long, root long"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, weights, names, roots, partners = (np.frombuffer(row[c], np.int64) for c in ("ids", "weights", "names", "roots", "partners"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (names[0::2], names[1::2], ids, weights, partners, roots))], names=["h1", "h2", "first", "weight", "partners", "root"])


# ---- pairs of leaves


_FOUND = T.StructType([T.StructField("a", T.LongType()), T.StructField("partners", T.LongType()), T.StructField("b", T.LongType())])


class _Side:
    """A leaf as a task compares it: points by place, local roots numbered."""

    def __init__(self, row: dict, double: bool):
        # copies, so that no batch is kept
        self.ids, self.weights, roots = (np.frombuffer(row[c], np.int64).copy() for c in ("ids", "weights", "roots"))
        self.roots, self.root = np.unique(roots, return_inverse=True)
        self.tree = Tree.read(row["tree"], unit(np.frombuffer(row["vectors"], np.float64 if double else np.float32).reshape(len(self.ids), -1)))
        self.bytes = 2 * self.tree.vectors.nbytes


def _join_leaves(threshold: float, double: bool):
    """Over pairs of leaves: ``(a, partners, null)`` per point its linked weight, ``(a, null, b)`` a spanning forest of the linked local roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: OrderedDict[tuple, _Side] = OrderedDict()
        kept, waiting = 0, 0
        partners: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        links: list[np.ndarray] = []

        def forest() -> np.ndarray:
            pairs = np.concatenate(links)
            ids, place = np.unique(pairs, return_inverse=True)
            place = place.reshape(pairs.shape)
            least = _least_reachable(len(ids), place[:, 0], place[:, 1])
            child = np.flatnonzero(least != np.arange(len(ids)))
            return np.stack([ids[child], ids[least[child]]], axis=1)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("a_label", "a_size", "a_leaf", "b_leaf")), strict=True))
            for k, (label, size, *leaves) in enumerate(keys):
                pair = []
                for s, leaf in zip("ab", leaves, strict=True):
                    key = (label, size, leaf)
                    if key in sides:
                        sides.move_to_end(key)
                    else:
                        sides[key] = _Side({c: batch.column(f"{s}_{c}")[k].as_buffer() for c in ("ids", "weights", "roots", "tree", "vectors")}, double)
                        kept += sides[key].bytes
                    pair.append((key, sides[key]))
                while kept > KEEP and len(sides) > 2:
                    kept -= sides.popitem(last=False)[1].bytes
                (key_a, a), (key_b, b) = pair
                i, j = linked(a.tree, b.tree, threshold)
                if not len(i):
                    continue
                for key, side, at, weights in ((key_a, a, i, b.weights[j]), (key_b, b, j, a.weights[i])):
                    total = partners.setdefault(key, (side.ids, np.zeros(len(side.ids), np.int64)))[1]
                    total += np.bincount(at, weights=weights, minlength=len(total)).astype(np.int64)
                met = np.zeros((len(a.roots), len(b.roots)), bool)
                met[a.root[i], b.root[j]] = True
                x, y = np.nonzero(met)
                links.append(np.stack([a.roots[x], b.roots[y]], axis=1))
                waiting += len(x)
                if waiting > 1 << 20:
                    links, waiting = [forest()], 0
        if not partners:
            return
        for ids, total in partners.values():
            got = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(total[got]), pa.nulls(len(got), pa.int64())], names=_FOUND.names)
        pairs = forest()
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 1])], names=_FOUND.names)

    return run


def _compare(leaves: DataFrame, bytes_: int, threshold: float, double: bool) -> DataFrame:
    """What ``_join_leaves`` finds in the pairs of different leaves that covering radii can't rule out, with neither side shuffled."""
    chord = float(np.sqrt(2 - 2 * threshold))
    columns = ("label", "size", "leaf", "centre", "far", "ids", "weights", "roots", "tree", "vectors")
    # small buckets still give every core a few pairs of parts
    least = math.isqrt(3 * leaves.sparkSession.sparkContext.defaultParallelism) + 1
    a, b = (leaves.select(*[F.col(c).alias(f"{s}_{c}") for c in columns]).coalesce(max(least, -(-bytes_ // part))) for s, part in (("a", LEFT), ("b", RIGHT)))
    square = F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = F.sqrt(square) <= F.col("a_far") + F.col("b_far") + F.lit(chord + SLACK)
    same_root = (F.col("a_label") == F.col("b_label")) & (F.col("a_size") == F.col("b_size"))
    pairs = a.hint("shuffle_replicate_nl").join(b, same_root & (F.col("a_leaf") < F.col("b_leaf")) & near)
    return pairs.drop("a_centre", "b_centre", "a_far", "b_far").mapInArrow(_join_leaves(threshold, double), _FOUND)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", leaf: int = LEAF) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    spark = embeddings.sparkSession
    chord = float(np.sqrt(2 - 2 * threshold))
    # single precision stays as it is, everything else is taken as double
    kind = embeddings.select(vector).schema[0].dataType
    double = not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType))
    values = F.col(vector).cast("array<double>") if double else F.col(vector)
    rows = embeddings.select(F.col(label).cast("long").alias("label"), F.col(vec_id).cast("long").alias("vec_id"), values.alias("vector"))
    every = materialise(rows.mapInArrow(_named(embeddings.count()), _NAMED), "names")
    usable = every.filter(F.col("h1").isNotNull())
    # an estimate is enough: it decides how roots are cut, not what is compared
    large = usable.groupBy("label", "size").agg(F.approx_count_distinct("h1").alias("n")).filter(F.col("n") > leaf)
    sample = usable.filter(F.col("sample").isNotNull()).groupBy("label", "size", "h1", "h2").agg(F.first("sample").alias("sample"))
    # at most SAMPLE bytes in all, and a row for each root of more than a leaf
    routes = sample.join(large, ["label", "size"]).groupBy("label", "size").applyInArrow(_routes(leaf, chord, double), _ROUTES).collect()
    cells, buckets, filled = {}, {}, [0, 0]
    for r in sorted(routes, key=lambda r: (r["label"], r["size"])):
        pieces = np.frombuffer(r["pieces"], np.int64)
        cells[r["label"], r["size"]] = np.frombuffer(r["centres"], np.int32).reshape(len(pieces), -1).astype(np.float64), pieces
        if filled[-1] >= BUCKET:
            filled.append(0)
        buckets[r["label"], r["size"]] = len(filled) - 1
        filled[-1] += r["n"] * r["size"]
    cells, buckets_sent = spark.sparkContext.broadcast(cells), spark.sparkContext.broadcast(buckets)
    points = rows.mapInArrow(_routed(cells, double), _POINTS)
    made = points.groupBy("label", "size", "cell", "piece").applyInArrow(_leaves(buckets_sent, threshold, leaf, double), _LEAF)
    at = scratch_path(spark, "leaves")
    made.write.partitionBy("bucket").parquet(at)
    leaves = spark.read.schema(made.schema).parquet(at)
    points = materialise(leaves.select("ids", "weights", "names", "roots", "partners").mapInArrow(_unpacked, _POINT), "points")
    before, after = (x.agg(F.sum(F.col("h1").cast("decimal(38,0)") * w)).first()[0] for x, w in ((usable, F.lit(1)), (points, F.col("weight"))))
    if before != after:
        raise RuntimeError("the vectors were not the same when they were read again; write them first")
    found_at = scratch_path(spark, "links-of-leaves")
    # there may be no bucket to compare
    spark.range(0).select(*[F.col("id").alias(c) for c in _FOUND.names]).write.parquet(f"{found_at}/bucket=0")
    for bucket, size in enumerate(filled[1:], 1):
        _compare(leaves.filter(F.col("bucket") == bucket), size, threshold, double).write.parquet(f"{found_at}/bucket={bucket}")
    remove_folder(spark, at)
    found = spark.read.schema(_FOUND).parquet(found_at)
    counted = points.select("first", "partners", "root").unionByName(found.filter(F.col("b").isNull()).select(F.col("a").alias("first"), "partners", F.lit(None).cast("long").alias("root")))
    totals = counted.groupBy("first").agg(F.sum("partners").alias("partners"), F.min("root").alias("least"), F.max("root").alias("most"))
    totals = materialise(totals, "partners")
    links = found.filter(F.col("b").isNotNull()).select("a", "b")
    # an id that stands for several points joins their components
    shared = totals.filter("least < most").select("first", "least")
    if not shared.isEmpty():
        links = links.unionByName(points.join(shared, "first").select(F.col("root").alias("a"), F.col("least").alias("b")))
    stars = components(links)
    facts = (
        points.drop("partners").join(totals.select("first", "partners"), "first").join(stars, F.col("root") == stars["node"], "left")
        .select("h1", "h2", (F.col("weight") - 1 + F.col("partners")).alias("n_links"), F.coalesce("component", "root").alias("component_id"))
    )
    mine = usable.select("vec_id", "h1", "h2").join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = every.filter(F.col("h1").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return mine.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
