"""Ordered scans that stay parallel when one key holds a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one
task. Here a key is first cut into *blocks* whose order agrees with the row
order (a calendar day, a minute, a fixed-width range of ids). Block totals are
pre-aggregated on the map side, the running value at each block's start comes
from a window over those few totals, and the row-level window then runs inside
one block only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

# Session setting and its default.
# Width of a block of ids or positions. They are unique, so a block never holds more rows than this.
BLOCK_ROWS = ("spark.tallyline.blockRows", 65_536)


def setting(name_and_default: tuple[str, int]) -> int:
    name, default = name_and_default
    return int(SparkSession.active().conf.get(name, str(default)))


def id_block(column: str) -> Column:
    return F.floor(F.col(column) / F.lit(setting(BLOCK_ROWS))).cast("long")


def position_levels(column: str) -> dict[str, Column]:
    """Blocks of positions within a key. A window over a key's blocks sorts one row per 65,536, so one level is enough."""
    return {"part": F.floor(F.col(column) / setting(BLOCK_ROWS)).cast("long")}


@dataclass(frozen=True)
class Running:
    """One running value, the current row included.

    ``kind`` is ``sum`` or ``max`` (of ``value``), ``last`` (latest non-null
    ``value``), ``max_before`` (of all earlier rows only) or ``lag`` (``value``
    of the row before, which may be null).
    """

    name: str
    kind: str
    value: Column


def running_sum(name: str, value: Column) -> Running:
    return Running(name, "sum", value)


def running_last(name: str, value: Column) -> Running:
    return Running(name, "last", value)


def running_max_before(name: str, value: Column) -> Running:
    return Running(name, "max_before", value)


def running_lag(name: str, value: Column) -> Running:
    return Running(name, "lag", value)


def _over(r: Running, window: WindowSpec) -> Column:
    if r.kind == "lag":
        return F.lag(r.value).over(window)
    if r.kind == "max_before":
        return F.max(r.value).over(window.rowsBetween(Window.unboundedPreceding, -1))
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}[r.kind]
    return made(r.value).over(frame)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n] == right[n] for n in names])


def blocked(
    df: DataFrame,
    keys: Sequence[str],
    levels: dict[str, Column],
    order: Sequence[Column],
    running: Sequence[Running],
) -> DataFrame:
    """Running values with every key cut into blocks.

    ``levels`` are block columns, coarse first; sorting by (levels, order) must
    be the same as sorting by ``order``. The window over block totals at a
    level runs within the level above it.
    """
    # every key takes this way, whatever its size: behaviour must not depend on how much data there is
    keys = list(keys)
    level_names = [f"_b{i}" for i in range(len(levels))]
    grain = keys + level_names
    rows = df.select("*", *[c.alias(n) for n, c in zip(level_names, levels.values(), strict=True)])
    # block totals and the rows themselves read this one exchange, so the input is evaluated once
    rows = rows.repartition(*[F.col(n) for n in grain])

    def seed(r: Running) -> Column:
        if r.kind in ("sum", "max", "max_before"):
            return F.sum(r.value) if r.kind == "sum" else F.max(r.value)
        # the latest value of a block is the largest (order, value) pair
        pair = F.struct(*_positions(order), r.value.alias("v"))
        return F.max(pair if r.kind == "lag" else F.when(r.value.isNotNull(), pair))

    totals = rows.groupBy(*grain).agg(*[seed(r).alias(f"_t_{r.name}") for r in running])

    def merged(r: Running) -> Column:
        return F.sum(f"_t_{r.name}") if r.kind == "sum" else F.max(f"_t_{r.name}")

    starts = None
    for depth in range(1, len(level_names) + 1):
        here = keys + level_names[:depth]
        above = keys + level_names[: depth - 1]
        # A level's own totals are few: they are what the window sorts.
        level = totals if depth == len(level_names) else totals.groupBy(*here).agg(
            *[merged(r).alias(f"_t_{r.name}") for r in running]
        )
        before = Window.partitionBy(*above).orderBy(level_names[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*here, *[merged(r).over(before).alias(f"_s_{r.name}") for r in running])
        if starts is not None:
            up = starts.select(
                *[F.col(n).alias(f"_u_{n}") for n in above], *[F.col(f"_s_{r.name}").alias(f"_u_s_{r.name}") for r in running]
            )
            condition = reduce(lambda a, b: a & b, [level[n] == up[f"_u_{n}"] for n in above])
            joined = level.join(up, condition)
            level = joined.select(
                *here,
                *[_combine(r, F.col(f"_u_s_{r.name}"), F.col(f"_s_{r.name}")).alias(f"_s_{r.name}") for r in running],
            )
        starts = level

    starts = starts.select(*[F.col(n).alias(f"_j_{n}") for n in grain], *[f"_s_{r.name}" for r in running])
    inside = Window.partitionBy(*grain).orderBy(*order)
    joined = rows.join(starts, reduce(lambda a, b: a & b, [rows[n] == starts[f"_j_{n}"] for n in grain]))
    out = []
    for r in running:
        start = F.col(f"_s_{r.name}")
        if r.kind == "sum":
            value = F.coalesce(start, F.lit(0)) + _over(r, inside)
        elif r.kind in ("max", "max_before"):
            value = F.greatest(start, _over(r, inside))
        elif r.kind == "last":
            value = F.coalesce(_over(r, inside), start["v"])
        else:
            # wrapped, so that a null in the row before is told from no row before
            before = F.lag(F.struct(r.value.alias("v"))).over(inside)
            value = F.when(before.isNotNull(), before["v"]).otherwise(start["v"])
        out.append(value.alias(r.name))
    # the starts have names of their own, so columns are picked by name
    return joined.select(*df.columns, *out)


def _positions(order: Sequence[Column]) -> list[Column]:
    return [c.alias(f"o{i}") for i, c in enumerate(order)]


def _combine(r: Running, above: Column, here: Column) -> Column:
    if r.kind == "sum":
        return F.coalesce(above, F.lit(0)) + F.coalesce(here, F.lit(0))
    # both are largest (order, value) pairs or plain maxima; `greatest` skips nulls
    return F.greatest(above, here)


def with_halo(df: DataFrame, index: str, width: int) -> DataFrame:
    """Cut numbered rows (1, 2, …) into blocks and repeat the last ``width`` rows of each in the next one.

    A frame of at most ``width`` earlier rows then lies inside ``_block``; keep
    the rows with ``_own = _block`` afterwards. A short key is one block.
    """
    block_rows = max(setting(BLOCK_ROWS), width)
    at = F.col(index) - 1
    block = F.floor(at / block_rows).cast("long")
    tail = at % block_rows >= block_rows - width
    homes = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    return df.withColumn("_own", block).withColumn("_block", F.explode(homes))


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_own") == F.col("_block")).drop("_own", "_block")
