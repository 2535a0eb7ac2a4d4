"""Late rows kept aside, and activity sessions of what came in time.

Spark drops rows behind the watermark without a trace. ``split_late`` draws the
line itself, by the same rule (the latest event time of all earlier
micro-batches less the delay), and writes each micro-batch once, parted into
rows in time and late rows. A stream with the same delay over the rows in time
then drops nothing: whatever its own micro-batches are, its watermark is never
ahead of the line a row has passed. So sessions and late rows together are all
rows, each once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .games import HEARTBEAT
from .live import run_available

DELAY_MINUTES = 10


def split_late(
    spark: SparkSession, rows: DataFrame, time: str = "fed_at", delay_minutes: int = DELAY_MINUTES, out: str | None = None, progress: str | None = None
) -> str:
    """Run over what is there now; returns the folder: ``rows/batch=N/late=false|true`` and the line after each batch.

    A batch that runs again finds the line of the batch before it and writes to
    the same place. With ``out`` and ``progress`` of an earlier run it goes on.
    Rows without a time are late: no watermark can place them.
    """
    out = out or scratch_path(spark, "split")

    def keep(batch: DataFrame, batch_id: int) -> None:
        line = None
        if batch_id > 0:
            line = spark.read.parquet(f"{out}/line/batch={batch_id - 1}").first()["line"]
        late = F.col(time).isNull() if line is None else F.coalesce(F.col(time) < F.lit(line), F.lit(True))
        target = f"{out}/rows/batch={batch_id}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(target)
        written = spark.read.schema(batch.schema).parquet(target)
        seen = written.agg((F.max(time) - F.lit(dt.timedelta(minutes=delay_minutes))).alias("line"))
        # one row; the line never moves back
        seen.select(F.greatest("line", F.lit(line).cast("timestamp")).alias("line")).write.mode("overwrite").parquet(f"{out}/line/batch={batch_id}")

    run_available(rows.writeStream.foreachBatch(keep), "split", spark, progress)
    return out


def late_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The side table: rows that came behind the line, with the number of their micro-batch."""
    parted = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("late", T.BooleanType())])
    found = spark.read.schema(parted).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return found.filter("late").drop("late")


def rows_in_time(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    """The other rows, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/rows/batch=*/late=false")


def session_stream(plays: DataFrame, gap: str, time: str = "fed_at", delay_minutes: int = DELAY_MINUTES) -> DataFrame:
    """A row per game and session: plays less than ``gap`` apart, final once the watermark has passed the session's end."""
    told = plays.withWatermark(time, f"{delay_minutes} minutes").filter((F.col("event_type") != HEARTBEAT) | F.col(time).isNull())
    grouped = told.groupBy("game_id", F.session_window(time, gap).alias("session")).agg(
        F.count(F.lit(1)).alias("plays"), F.sum(F.when(F.col("event_type") == "goal", 1).otherwise(0)).alias("goals"),
        F.min("event_id").alias("least_event"), F.max("event_id").alias("greatest_event"),
    )
    return grouped.select("game_id", F.col("session.start").alias("starts"), F.col("session.end").alias("ends"), "plays", "goals", "least_event", "greatest_event")


def run_sessions(spark: SparkSession, plays: DataFrame, gap: str, **more) -> DataFrame:
    made = session_stream(plays, gap, **more)
    out = scratch_path(spark, "sessions")
    run_available(made.writeStream.outputMode("append").format("parquet").option("path", out), "sessions", spark)
    return spark.read.schema(made.schema).parquet(out)
