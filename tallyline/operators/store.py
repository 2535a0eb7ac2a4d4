"""Table merges: upserts, guarded updates, inserts of what is absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pair(old: DataFrame, new: DataFrame, keys: list[str], how: str, order: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Old rows beside the one new row of their key: the last by ``order`` (by all its columns where no order is given)."""
    new = keep_last(new, keys, order or [c for c in new.columns if c not in keys])
    names = [c for c in old.columns if c not in keys]
    incoming = new.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new")
    )
    same = reduce(lambda a, b: a & b, [old[k] == incoming[f"_k_{k}"] for k in keys])
    return old.withColumn("_old", F.lit(True)).join(incoming, same, how), names


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), guard: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """Insert new keys and update old ones.

    ``keep`` columns hold their old value; rows that fail ``guard`` (over the
    old columns) are not updated at all. Columns the new side lacks stay as they are.
    Of several new rows with one key the last by ``order`` counts.
    """
    joined, names = _pair(old, new, keys, "full_outer", order)
    update = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))))
    have = set(new.columns)
    out = [F.coalesce(F.col(k), F.col(f"_k_{k}")).alias(k) for k in keys]
    for c in names:
        if c not in have:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.when(F.col("_old").isNull(), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(update, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    order = {c: i for i, c in enumerate(old.columns)}
    return joined.select(*out).select(*sorted(old.columns, key=order.get))


def update_where(old: DataFrame, new: DataFrame, keys: list[str], guard: Column, sets: dict[str, Column], order: list[str] | None = None) -> DataFrame:
    """Set columns on old rows that have a new row and pass ``guard``; adds ``changed``.

    ``sets`` may refer to new columns as ``_n_<name>``. Nothing is inserted.
    """
    joined, names = _pair(old, new, keys, "left", order)
    hit = F.col("_new").isNotNull() & F.coalesce(guard, F.lit(False))
    cols = [F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in old.columns]
    return joined.select(*cols, hit.alias("changed"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Append only rows whose key is not there yet; of several new ones the first by ``order`` (by all their columns)."""
    new = keep_first(new, keys, order or [c for c in new.columns if c not in keys])
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``; a max over a struct, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    oldest = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return oldest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)
