"""What several operators share: appended columns, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise, remove_folder, ship

__all__ = ["components", "free_name", "remove_folder", "ship", "table", "with_computed"]

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores in front until no column has that name (Spark's names ignore case)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def with_computed(
    df: DataFrame, inputs: list[str], fields: dict[str, T.DataType], compute: Callable[..., dict[str, object]]
) -> tuple[DataFrame, dict[str, str]]:
    """Append columns that ``compute(*input arrays)`` returns for each Arrow batch.

    No shuffle, no join: rows and their other columns pass through untouched.
    Returns the frame and, for each field, the name it got (a clash with an
    existing column adds underscores).
    """
    names, taken = {}, list(df.columns)
    for field in fields:
        names[field] = free_name(field, taken)
        taken.append(names[field])
    schema = T.StructType([*df.schema.fields, *[T.StructField(names[f], t) for f, t in fields.items()]])
    added = to_arrow_schema(T.StructType([T.StructField(f, t) for f, t in fields.items()]))
    at = [df.columns.index(c) for c in inputs]
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = compute(*[batch.column(i) for i in at])
            new = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], type=f.type) for f in added]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=out_names)

    return df.mapInArrow(run, schema), names


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the pairs ``(a, b)``: the smallest node reachable.

    Alternating large-star and small-star steps: every node is linked to the
    smallest neighbour, as plain aggregations and joins, until only stars
    remain. Each round is written to the shared folder, so lineage stays short
    and nothing is gathered on the driver but two numbers.
    """
    pairs = (
        edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct()
    )
    pairs = materialise(pairs, "links")
    seen = None
    for _ in range(rounds):
        both = pairs.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(
            pairs.select(F.col("high").alias("node"), F.col("low").alias("other"))
        )
        nearest = both.groupBy("node").agg(F.min("other").alias("least"))
        nearest = nearest.select("node", F.least("node", "least").alias("least"))
        large = both.join(nearest, "node").filter("other > node").select(F.col("least").alias("low"), F.col("other").alias("high"))
        large = materialise(large.filter("low < high").distinct(), "links")
        nearest = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        small = (
            large.join(nearest, large["high"] == nearest["node"])
            .select(F.col("least").alias("first"), F.explode(F.array("low", "high")).alias("second"))
            .filter("first < second")
            .select(F.col("first").alias("low"), F.col("second").alias("high"))
        )
        pairs = materialise(small.distinct(), "links")
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
    else:
        raise RuntimeError("components did not settle")
    stars = pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))
    roots = pairs.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return stars.unionByName(roots.join(stars, "node", "left_anti"))
