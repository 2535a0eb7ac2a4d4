"""Aggregates of box scores and play-by-play per game side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import clock_seconds
from ..functions.contest import ATTEMPTS, ON_GOAL, REGULAR
from ..functions.numbers import ratio, round_even

EVEN_STRENGTH = "1551"


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def side_counts(plays: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, shots on goal and goals per group, overall and at even strength; plays without a side are left out."""
    kind = F.col("event_type")
    even = F.coalesce(F.col("situation_code").cast("string") == EVEN_STRENGTH, F.lit(False))
    attempt, on_goal, goal = kind.isin(*ATTEMPTS), kind.isin(*ON_GOAL), kind == "goal"
    return plays.filter(F.col("side").isNotNull()).groupBy(*keys).agg(
        _count(attempt).alias("shot_attempts"),
        _count(on_goal).alias("shots_on_goal"),
        _count(goal).alias("goals"),
        _count(attempt & even).alias("es_shot_attempts"),
        _count(on_goal & even).alias("es_shots_on_goal"),
        _count(goal & even).alias("es_goals"),
    )


def even_strength_sides(plays: DataFrame) -> DataFrame:
    """Per game side its even-strength attempts and goals, for and against, from one aggregation."""
    kind = F.col("event_type")
    even = F.coalesce(F.col("situation_code").cast("string") == EVEN_STRENGTH, F.lit(False))
    counts = []
    for side in ("home", "away"):
        own = even & (F.col("side") == side)
        seen = F.max(F.when(F.col("side") == side, True))
        counts += [
            F.when(seen, _count(own & kind.isin(*ATTEMPTS))).cast("double").alias(f"{side}_attempts"),
            F.when(seen, _count(own & (kind == "goal"))).cast("double").alias(f"{side}_goals"),
        ]
    per_game = plays.groupBy("game_id").agg(*counts)

    def view(own: str, other: str, is_home: int) -> Column:
        return F.struct(
            F.lit(is_home).cast("long").alias("is_home"),
            F.col(f"{own}_attempts").alias("es_shot_attempts_for"),
            F.col(f"{other}_attempts").alias("es_shot_attempts_against"),
            F.col(f"{own}_goals").alias("es_goals_for"),
            F.col(f"{other}_goals").alias("es_goals_against"),
        )

    return per_game.select("game_id", F.explode(F.array(view("home", "away", 1), view("away", "home", 0))).alias("s")).select(
        "game_id", "s.*"
    )


def skater_totals(skaters: DataFrame, keys: list[str]) -> DataFrame:
    """Skater sums and mean time on ice per game side."""
    toi = clock_seconds(F.col("time_on_ice")).cast("double")
    summed = ("goals", "assists", "points", "shots", "hits", "blocked_shots")
    return skaters.groupBy(*keys).agg(
        F.count("player_id").alias("skater_count"),
        *[F.sum(c).alias(f"skaters_{c}") for c in summed],
        F.avg(toi).alias("skaters_avg_toi_seconds"),
    )


# fixed value: save share from which a start counts as a quality start
QUALITY_START = 0.9


def starters(goalies: DataFrame, keys: list[str], ingest_order: str) -> DataFrame:
    """The goalie with the most time on ice per game side, the first listed on a tie.

    ``max_by`` combines before the shuffle, so no group is collected. An
    unknown save share counts as no quality start.
    """
    toi = clock_seconds(F.col("time_on_ice"))
    rows = goalies.filter(toi.isNotNull())
    rank = F.struct(toi, -F.col(ingest_order), -F.col("player_id"))
    kept = ("player_id", "goalie_name", "save_pct", "goals_against", "shots_against")
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), rank).alias("g"))
    return best.select(
        *keys,
        F.col("g.player_id").alias("starting_goalie_id"),
        F.col("g.goalie_name").alias("starting_goalie_name"),
        F.col("g.save_pct").cast("double").alias("starting_goalie_save_pct"),
        F.col("g.goals_against").cast("double").alias("starting_goalie_goals_against"),
        F.col("g.shots_against").cast("double").alias("starting_goalie_shots_against"),
        F.when(F.col("g.save_pct") >= QUALITY_START, 1.0).otherwise(0.0).alias("starting_goalie_quality_start"),
    )


# fixed values: box metrics of a team line
BOX_METRICS = (
    "shots_for", "shots_against", "powerplay_goals", "penalty_minutes", "faceoff_win_pct", "blocked_shots", "hits",
    "giveaways", "takeaways",
)


def with_opponent(box: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the opponent line's columns (``{source: new name}``) by joining the table to itself on the other side."""
    other = box.select(
        "game_id", (1 - F.col("is_home")).alias("is_home"), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    return box.join(other, ["game_id", "is_home"], "left")


def full_history(team_games: DataFrame, box: DataFrame, plays: DataFrame, goalies: DataFrame, skaters: DataFrame) -> DataFrame:
    """Team-game rows with box, even-strength, starter and skater columns; all joined on (game_id, is_home)."""
    key = ["game_id", "is_home"]
    lines = with_opponent(box, {"shots_for": "shots_against"})
    players = skater_totals(skaters, key).select(*key, "skaters_points", "skaters_shots", "skaters_avg_toi_seconds")
    return (
        team_games.join(lines.select(*key, *[F.col(c).cast("double").alias(c) for c in BOX_METRICS]), key, "left")
        .join(even_strength_sides(plays), key, "left")
        .join(starters(goalies, key, "line_order"), key, "left")
        .join(players, key, "left")
    )


def team_season_stats(lines: DataFrame) -> DataFrame:
    """Regular-season means and special-team percentages per (season, team).

    ``lines`` holds one row per team and game with goals and box columns plus
    the opponent's power-play columns ``opp_pp_goals`` and ``opp_pp_opps``.
    """
    regular = lines.filter(F.col("game_type") == REGULAR)
    total = lambda c: F.sum(c)
    kill = 1 - ratio(total("opp_pp_goals"), total("opp_pp_opps"))
    return regular.groupBy("season", "team").agg(
        F.count(F.lit(1)).alias("games"),
        round_even(F.avg("goals_for"), 2).alias("goals_for"),
        round_even(F.avg("goals_against"), 2).alias("goals_against"),
        round_even(100 * ratio(total("powerplay_goals"), total("powerplay_opportunities")), 1).alias("power_play"),
        round_even(100 * kill, 1).alias("penalty_kill"),
        round_even(F.avg("shots_for"), 1).alias("shots_per_game"),
        round_even(100 * F.avg("faceoff_win_pct"), 1).alias("faceoff_win"),
    )
