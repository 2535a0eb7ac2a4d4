"""Daily sketches that merge over any range of days, and the errors they are held to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registers (2^12) of a distinct-count sketch: relative standard error 1.04 / sqrt(2^12), held to four of them.
LG_REGISTERS = 12
DISTINCT_ERROR = 4 * 1.04 / 2 ** (LG_REGISTERS / 2)
# Size of a quantile sketch and the error of a rank that it keeps with 99 % confidence (1.33 % at 200), held to twice that.
QUANTILE_SIZE = 200
RANK_ERROR = 2 * 0.0133


def daily_sketches(rows: DataFrame, day: str, key: str, size: str) -> DataFrame:
    """One row per day: a sketch of the distinct ``key`` and one of the values of ``size``.

    Both are partial aggregates, a few kilobytes a day however many rows the day
    has. Null keys and sizes enter no sketch; a null day has a row of its own.
    """
    return rows.groupBy(day).agg(
        F.hll_sketch_agg(key, LG_REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_bigint(F.col(size), F.lit(QUANTILE_SIZE)).alias("size_sketch"),
    )


def merged(daily: DataFrame, span: str) -> DataFrame:
    """Estimates per ``span`` from the daily sketches alone: distinct keys, truncated median and upper decile of the sizes."""
    sums = daily.groupBy(span).agg(
        F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_bigint(F.col("size_sketch"), F.lit(QUANTILE_SIZE)).alias("q")
    )
    quantile = lambda share: F.kll_sketch_get_quantile_bigint(F.col("q"), F.lit(share))
    return sums.select(
        span, F.hll_sketch_estimate("d").alias("distinct_estimate"), quantile(0.5).alias("median_estimate"), quantile(0.9).alias("upper_estimate"),
    )


def _rank_holds(below: Column, upto: Column, total: Column, share: float) -> Column:
    """A value with ``below`` rows under it and ``upto`` rows up to it may stand for the quantile ``share``."""
    return (below / total <= share + RANK_ERROR) & (upto / total >= share - RANK_ERROR)


def within_error(estimates: DataFrame, exact: DataFrame, rows: DataFrame, span: str, size: str = "n") -> DataFrame:
    """Exact counts per span with three flags: distinct count, median and upper decile lie within the stated errors.

    The rank of an estimate is counted over all rows. ``exact`` has ``games``,
    ``events`` and ``game_days`` per span; there is one estimate row per span.
    """
    placed = rows.join(estimates.withColumnRenamed(span, "_span"), F.col(span) == F.col("_span"))
    count = lambda c: F.sum(c.cast("long"))
    ranks = placed.groupBy(span).agg(
        *[count(F.col(size) < F.col(f"{q}_estimate")).alias(f"{q}_below") for q in ("median", "upper")],
        *[count(F.col(size) <= F.col(f"{q}_estimate")).alias(f"{q}_upto") for q in ("median", "upper")],
    )
    joined = exact.join(estimates, span).join(ranks, span)
    off = F.abs(F.col("distinct_estimate") - F.col("games")) / F.col("games")
    flags = [
        _rank_holds(F.col(f"{q}_below"), F.col(f"{q}_upto"), F.col("game_days"), share).alias(f"{q}_ok") for q, share in (("median", 0.5), ("upper", 0.9))
    ]
    return joined.select(span, "games", "events", "game_days", (off <= DISTINCT_ERROR).alias("distinct_ok"), *flags)
