"""Feature rows and predictions for games not yet played."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contest import confidence, fair_odds, pick_home
from ..functions.numbers import round_even
from . import history, matchups, ratings

# fixed values: diffs of the serving row that pair opposite splits
OPPOSITE = {
    "home_ice_split_win_pct_diff": ("home_home_win_pct_before_game", "away_road_win_pct_before_game"),
    "home_ice_split_goal_diff_avg_diff": ("home_home_goal_diff_avg_before_game", "away_road_goal_diff_avg_before_game"),
}


def inferred_differences(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Home-minus-away columns named in ``wanted`` that are not there yet.

    The two sides carry the plain name or the one ending in
    ``_before_game``; two differences pair opposite splits.
    """
    have = set(df.columns)
    made: dict[str, Column] = {}
    for column in wanted:
        if not column.endswith("_diff") or column in have:
            continue
        base = column[: -len("_diff")]
        pairs = [OPPOSITE[column]] if column in OPPOSITE else [(f"home_{base}{e}", f"away_{base}{e}") for e in ("", "_before_game")]
        found = next((p for p in pairs if have.issuperset(p)), None)
        if found:
            made[column] = F.col(found[0]) - F.col(found[1])
    return df.withColumns(made) if made else df


def rated(asked: DataFrame, states: DataFrame) -> DataFrame:
    """Rating columns of upcoming pairings; games of teams without a state are left out."""
    out = asked
    for side in ("home", "away"):
        part = states.select(
            F.col("team").alias(f"{side}_team"), F.col("elo").alias(f"{side}_elo_pre"),
            F.col("decay_gd").alias(f"{side}_decay_goal_diff"), F.col("decay_win").alias(f"{side}_decay_win_rate"),
        )
        out = out.join(part, f"{side}_team")
    return out.select(*asked.columns, *ratings.matchup_columns())


def skipped(asked: DataFrame, states: DataFrame) -> DataFrame:
    """Upcoming games that have a team without a state."""
    known = states.select("team")
    home = asked.join(known.withColumnRenamed("team", "home_team"), "home_team", "left_anti")
    away = asked.join(known.withColumnRenamed("team", "away_team"), "away_team", "left_anti")
    return home.select("game_id").union(away.select("game_id")).distinct()


def upcoming_rows(games: DataFrame, asked: DataFrame, states: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Rows for asked games: carried-forward features, fresh form (rest capped at 14), head to head, ratings, zeros for the series, differences.

    ``carried`` holds one row per team with features that only the full data
    set gives. Columns without a value stay null.
    """
    done = history.eligible(games)
    days = history.team_days(history.team_games(done), history.asks_of(asked), history.SCORE_METRICS)
    rows = history.attach(asked, history.features(days, rest_cap=14))
    if carried is not None:
        names = [c for c in carried.columns if c != "team" and f"home_{c}" not in rows.columns]
        for side in ("home", "away"):
            part = carried.select(F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in names])
            rows = rows.join(part, f"{side}_team", "left")
    rows = rated(matchups.head_to_head(done, rows, keys_of=asked), states)
    zero = {c: F.lit(0.0) for c in (*matchups.SERIES_COLUMNS, "is_playoff")}
    return inferred_differences(rows.withColumns(zero), list(history.diff_pairs()))


def prediction_columns(p: Column) -> dict[str, Column]:
    """What is published about a prediction."""
    return {
        "home_win_prob": round_even(100 * p, 1),
        "confidence": round_even(100 * confidence(p), 1),
        "home_odds": fair_odds(p),
        "away_odds": fair_odds(1 - p),
        "pick": F.when(pick_home(p), F.col("home_team")).otherwise(F.col("away_team")),
    }
