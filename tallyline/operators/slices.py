"""Ranges, tails and id predicates over games and reviews. The limits here are the feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def season_range(seasons: Column, start: int | None = None, end: int | None = None) -> Column:
    """Whether a season lies between two bounds; a bound that is not given is open."""
    low = F.lit(True) if start is None else seasons >= start
    high = F.lit(True) if end is None else seasons <= end
    return low & high


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows by ``order``; each task passes on at most ``n``."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def recent_games(games: DataFrame, start: int | None, end: int | None, max_games: int) -> DataFrame:
    """The last games of a range of seasons by date and id."""
    return tail(games.filter(season_range(F.col("season"), start, end)), ["game_date", "game_id"], max_games)


def id_kind(game_id: Column) -> Column:
    """Digits five and six of a ten-digit id: the kind of game."""
    return F.substring(game_id.cast("string"), 5, 2)


def review_tail(review: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` rows of a filtered review, newest first, with their place."""
    last = tail(review, ["game_date", "game_id"], limit)
    packed = last.agg(F.sort_array(F.collect_list(F.struct("game_date", "game_id")), asc=False).alias("rows"))  # at most `limit` rows
    return packed.select(F.posexplode("rows").alias("place", "r")).select("place", "r.game_id", "r.game_date")


def season_id_set(saved: Column, today: Column, horizon: Column) -> Column:
    """The distinct known seasons among the saved one, today's and the horizon's, in that order."""
    return F.array_distinct(F.filter(F.array(saved, today, horizon), lambda s: s.isNotNull()))
