"""Guarded merges into a stored table that rewrite only the partitions they change."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from ..sources.landing import conform, load_table
from .store import keep_last

# A delivery that names more partitions than this is matched by a semi-join instead of a list in the plan.
LISTED_PARTITIONS = 1_000
# Rows of one file of a rewritten partition; a larger partition gets more files, so that no task writes it alone.
ROWS_PER_FILE = 2_000_000


@dataclass(frozen=True)
class Merged:
    """What a merge did: rows inserted, rows whose values changed, partitions rewritten, rows with a null key left out."""

    inserted: int
    updated: int
    partitions: int
    rejected: int

    @property
    def changed(self) -> int:
        return self.inserted + self.updated


def merge_into(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    new: DataFrame,
    keys: tuple[str, ...],
    partition: str,
    sets: tuple[str, ...],
    guard: Column | None = None,
    insert: bool = True,
    order: tuple[str, ...] = (),
    rows_per_file: int = ROWS_PER_FILE,
) -> Merged:
    """Merge ``new`` into the Parquet table at ``path``, partitioned by ``partition``.

    Stored rows whose key comes again get the ``sets`` columns if they pass
    ``guard`` (over the stored columns); other keys are appended if ``insert``.
    ``partition`` is one of ``keys``, so a row never moves. Only partitions named
    by the delivery are read, and of these only those with a row that really
    changes are rewritten: the same delivery again rewrites nothing. Of several
    new rows with one key the last by ``order`` counts. Rows with a null in a
    key are counted as ``rejected`` and left out; a table that is not there yet
    counts as empty; columns beside the schema are dropped.
    """
    if partition not in keys:
        raise ValueError("the partition column must be one of the keys")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # the delivery is read for its partitions, its keys and its nulls, so it is evaluated once
    delivered = materialise(conform(new, schema), "delivery")
    rest = [f.name for f in schema.fields if f.name not in keys]
    incoming = keep_last(delivered.filter(whole), list(keys), list(order) or rest)

    stored = load_table(spark, path, schema)
    named = delivered.filter(whole).select(partition).distinct()
    listed = named.limit(LISTED_PARTITIONS + 1).collect()
    if len(listed) <= LISTED_PARTITIONS:
        stored = stored.filter(F.col(partition).isin([r[0] for r in listed]))
    else:
        stored = stored.join(named, partition, "left_semi")

    fresh = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in rest], F.lit(True).alias("_new"))
    held = stored.withColumn("_old", F.lit(True))
    joined = held.join(fresh, reduce(lambda a, b: a & b, [held[k] == fresh[f"_k_{k}"] for k in keys]), "full_outer")
    added = F.col("_old").isNull()
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in sets], F.lit(False))
    passes = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    updated = ~added & F.col("_new").isNotNull() & passes & differs
    value = lambda c: F.when(added | (updated if c in sets else F.lit(False)), F.col(f"_n_{c}")).otherwise(F.col(c))
    made = joined.select(
        *[(F.coalesce(F.col(f.name), F.col(f"_k_{f.name}")) if f.name in keys else value(f.name)).alias(f.name) for f in schema.fields],
        added.alias("_added"), updated.alias("_updated"),
    )
    if not insert:
        made = made.filter(~F.col("_added"))
    # written before the table is touched: a run that is lost half way leaves the table as it was
    merged = materialise(made, "merged")
    sizes = merged.groupBy(partition).agg(
        F.sum(F.col("_added").cast("long")).alias("_i"), F.sum(F.col("_updated").cast("long")).alias("_u"), F.count(F.lit(1)).alias("_rows")
    )
    touched = materialise(sizes.filter(F.col("_i") + F.col("_u") > 0), "touched")
    total = touched.agg(F.coalesce(F.sum("_i"), F.lit(0)), F.coalesce(F.sum("_u"), F.lit(0)), F.count(F.lit(1))).first()
    if total[2]:
        files = touched.select(F.col(partition).alias("_p"), F.ceil(F.col("_rows") / rows_per_file).alias("_files"))
        rows = merged.join(files, F.col(partition) == F.col("_p"))
        dealt = rows.withColumn("_file", F.pmod(F.xxhash64(*keys), F.col("_files"))).repartition(F.col(partition), F.col("_file"))
        dealt.select(*[f.name for f in schema.fields]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(
            partition
        ).parquet(path)
    return Merged(*total, rejected=delivered.filter(~whole).count())


def partition_files(spark: SparkSession, path: str, schema: T.StructType, partition: str) -> DataFrame:
    """Rows, number of files and a digest of the file names of every partition of a stored table."""
    table = load_table(spark, path, schema)
    files = table.groupBy(partition, F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    return files.groupBy(partition).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.bit_xor(F.xxhash64("file")).alias("digest")
    )
