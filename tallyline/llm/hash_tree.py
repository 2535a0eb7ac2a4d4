"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends three levels. At each level every child of the node it stands
on draws ``-ln(u) / weight``, where ``u`` in (0, 1) is made of the first 52 bits
of the MD5 of the row's key and the child's label; the least draw wins, so a
child is chosen in proportion to its weight, and a draw never depends on the
other children. A changed weight therefore moves rows only into the subtree
that grew or out of the subtree that shrank.

A plain tree of this kind still stirs rows inside a subtree that grew: who
comes in because of a new shard may land in an old one. So weight is kept by
*epoch*: each change of the tree is an epoch, and an inner node is a child once
per epoch with the weight that epoch gave it. Who is won by an epoch's share
descends within that epoch's share. An added shard thus takes rows only into
itself, and nothing else moves.

Only DataFrame functions are used. The tree is a literal map of children, so the
work per row is one hash per child on its path; its size is the number of
leaves, a parameter.

Places: rows get gapless slots within their shard in the order of key, size and
checksum. The assigned rows (no texts) are written in range-partitioned order,
so any number of equal keys, null keys included, spreads over partitions, and
slots come from counts per (shard, partition): no shard meets in one task.

Null keys are one key of their own; null texts have no bytes; repeated rows are
rows of their own; an empty table gives no rows; further columns are left out
by ``place`` and kept by ``with_shard``, which adds underscores to its column
where the name is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .shared import free_name

LEVELS = 3
# 13 hexadecimal digits: as many bits as a double holds exactly
DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    """A shard's place, and the weight it got in one epoch."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0
    epoch: int = 0


Tree = tuple[Leaf, ...]


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> Tree:
    """Shards of equal weight, dealt over the regions and their racks in turn."""
    return tuple(Leaf(s, f"r{s % regions}", f"k{s // regions % racks}") for s in range(shards))


def add_weight(tree: Tree, shard: int, weight: float = 1.0, region: str | None = None, rack: str | None = None) -> Tree:
    """The tree with ``weight`` more for a shard, in an epoch of its own: rows move only into that shard.

    A new shard goes to the given region and rack, or else to the lightest ones.
    """
    old = next((leaf for leaf in tree if leaf.shard == shard), None)
    if old is not None:
        region, rack = old.region, old.rack

    def lightest(of: list[tuple[str, float]]) -> str:
        total: dict[str, float] = {}
        for name, w in of:
            total[name] = total.get(name, 0.0) + w
        return min(total, key=lambda name: (total[name], name)) if total else "r0"

    region = region or lightest([(leaf.region, leaf.weight) for leaf in tree])
    rack = rack or lightest([(leaf.rack, leaf.weight) for leaf in tree if leaf.region == region])
    return (*tree, Leaf(shard, region, rack, weight, 1 + max((leaf.epoch for leaf in tree), default=-1)))


def set_weight(tree: Tree, shard: int, factor: float) -> Tree:
    """The tree with a shard's weight times ``factor`` (at most 1; 0 takes it out): rows move only out of its subtrees."""
    if not 0 <= factor <= 1:
        raise ValueError("use add_weight to grow")
    made = [Leaf(x.shard, x.region, x.rack, x.weight * factor, x.epoch) if x.shard == shard else x for x in tree]
    return tuple(x for x in made if x.weight > 0)


def children(tree: Tree) -> dict[str, list[tuple[str, float, int | None]]]:
    """Parent's label -> (label, weight, shard) of its children; the root is the empty label."""
    if not tree or min(leaf.weight for leaf in tree) <= 0:
        raise ValueError("a tree needs shards of positive weight")
    weights: dict[tuple[str, str], float] = {}
    shard: dict[str, int] = {}
    for leaf in tree:
        path = (leaf.region, f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}")
        labels = ["", *[f"{p}@{leaf.epoch}" for p in path]]
        for parent, label in zip(labels, labels[1:], strict=False):
            weights[parent, label] = weights.get((parent, label), 0.0) + leaf.weight
        shard[labels[-1]] = leaf.shard
    out: dict[str, list[tuple[str, float, int | None]]] = {}
    for (parent, label), weight in weights.items():
        out.setdefault(parent, []).append((label, weight, shard.get(label)))
    return out


def key_text(key: Column) -> Column:
    """What is hashed: the key as text after a mark, or nothing where it is null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard a key descends to."""
    kind = "struct<label:string,weight:double,shard:int>"
    parts: list[Column] = []
    for parent, below in children(tree).items():
        parts += [F.lit(parent), F.array(*[F.struct(F.lit(a), F.lit(float(w)), F.lit(s).cast("int")).cast(kind) for a, w, s in below])]
    known = F.create_map(*parts)

    def draw(child: Column) -> Column:
        digits = F.conv(F.substring(F.md5(F.concat(key_text(key), F.lit("|"), child["label"]).cast("binary")), 1, DIGITS), 16, 10)
        u = (digits.cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["label"].alias("label"), child["shard"].alias("shard"))

    at = F.array_min(F.transform(F.element_at(known, F.lit("")), draw))
    for _ in range(LEVELS - 1):
        at = F.array_min(F.transform(F.element_at(known, at["label"]), draw))
    return at["shard"]


def with_shard(df: DataFrame, tree: Tree, key: str = "doc_id") -> tuple[DataFrame, str]:
    """All columns and the shard; for writing whole rows, say with ``write.partitionBy(name)``. No shuffle."""
    name = free_name("shard", df.columns)
    return df.withColumn(name, shard_of(F.col(key), tree)), name


def place(df: DataFrame, tree: Tree, grown: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` of every row; ``grown_shard`` is the shard in the grown tree."""
    body = F.coalesce(F.col(text), F.lit(""))
    assigned = df.select(
        F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"), shard_of(F.col(key), grown).alias("grown_shard"),
    )
    assigned = materialise(assigned, "shards")
    order = ["shard", "_key", "size", "text_crc32", "_tie"]
    ordered = assigned.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # partition and place in it, as written
    placed = materialise(ordered.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "slots")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_part", (before - F.col("_first")).alias("_shift"))
    slots = placed.join(starts, ["shard", "_part"])
    return slots.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") + F.col("_shift")).cast("long").alias("slot"), "grown_shard",
    )
