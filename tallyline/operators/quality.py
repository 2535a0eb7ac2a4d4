"""Checks that a data set has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contest import is_completed


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per id; one row."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def missing_artifacts(games: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Completed games without an artifact; the artifact keys are made distinct before the join."""
    done = games.filter(is_completed(F.col("game_state")))
    return done.select("game_id", "season").join(artifacts.select("game_id").distinct(), "game_id", "left_anti")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_report(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row per wanted column: whether it is there, and how many rows are null in it (null where it is not there)."""
    absent = set(missing_columns(df, list(required)))
    nulls = df.agg(*[(F.lit(None).cast("long") if c in absent else F.count_if(F.col(c).isNull())).alias(f"n{i}") for i, c in enumerate(required)])
    entry = [F.struct(F.lit(c).alias("name"), F.lit(c not in absent).alias("present"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(required)]
    return nulls.select(F.inline(F.array(*entry)))


def leakage(features: DataFrame) -> DataFrame:
    """Count rows whose newest source is not strictly before the day it serves: ``source_date`` against ``game_date``."""
    late = F.col("source_date").isNotNull() & (F.col("source_date") >= F.col("game_date"))
    return features.agg(
        F.count(F.lit(1)).alias("checked"),
        F.coalesce(F.sum(F.when(late, 1).otherwise(0)), F.lit(0)).alias("leaks"),
    )


def quality_report(games: DataFrame, boxes: DataFrame, plays: DataFrame) -> DataFrame:
    """One row: missing box scores, missing plays, upcoming games, duplicate ids."""
    counted = games.agg(F.coalesce(F.sum(F.when(is_completed(F.col("game_state")), 0).otherwise(1)), F.lit(0)).alias("upcoming_games"))
    parts = [
        missing_artifacts(games, boxes).agg(F.count(F.lit(1)).alias("missing_boxscores")),
        missing_artifacts(games, plays).agg(F.count(F.lit(1)).alias("missing_plays")),
        duplicate_ids(games, "game_id").withColumnRenamed("duplicates", "duplicate_games"),
    ]
    out = counted
    for part in parts:
        out = out.join(F.broadcast(part))  # one row each
    return out
