"""Reading the raw zone and writing tables with a fixed schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents below ``path`` (one per file) with the file each came from as ``path``."""
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return docs.select("*", F.col("_metadata.file_path").alias("path"))


def path_parts(docs: DataFrame) -> DataFrame:
    """Season, game and artifact of a document from ``…/<season>/<game_id>/<artifact>.json``."""
    parts = F.split("path", "/")
    return docs.withColumns(
        {
            "season": F.get(parts, F.size(parts) - 3).try_cast("bigint"),
            "game_id": F.get(parts, F.size(parts) - 2).try_cast("bigint"),
            "artifact": F.regexp_replace(F.get(parts, F.size(parts) - 1), r"\.json$", ""),
        }
    )


def load_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A table, or an empty one of the same schema where nothing has been written yet."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        return reader.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, in its order: missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def save_table(df: DataFrame, path: str, schema: T.StructType, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    writer = conform(df, schema).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def latest_snapshot(docs: DataFrame, column: str = "snapshot_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Only the documents of the newest snapshot (per ``keys``).

    The newest id is one small aggregate joined back, not a window over all documents.
    """
    if not keys:
        return docs.filter(F.col(column) == docs.agg(F.max(column)).scalar())
    newest = docs.groupBy(*keys).agg(F.max(column).alias(column))
    return docs.join(newest, [*keys, column], "left_semi")


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Write an export as JSON lines, one folder per section, so that no document has to fit into one task."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/section={name}")


def sections_frame(sections: dict[str, DataFrame]) -> DataFrame:
    """The same export as rows ``(section, document)``."""
    out = None
    for name, df in sections.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("document"))
        out = rows if out is None else out.unionByName(rows)
    return out
