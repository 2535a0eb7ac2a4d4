"""Form features on hand-computed books of games."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyline.operators import board, history, matchups, serving

SCHEMA = (
    "game_id long, season long, game_date date, home_team string, away_team string, home_score long, away_score long, "
    "last_period_type string, game_type long, game_state string"
)


def game(i, day, home, away, hs, as_, period="REG", season=20242025, state="OFF", kind=2):
    return (i, season, dt.date.fromisoformat(day), home, away, hs, as_, period, kind, state)


BOOK = [
    game(11, "2024-11-02", "ORCA", "LYNX", 2, 5),
    game(12, "2024-11-05", "LYNX", "IBIS", 3, 0),
    game(13, "2024-11-06", "IBIS", "LYNX", 4, 3),
    game(14, "2024-11-11", "LYNX", "ORCA", 1, 6),
    game(15, "2024-11-12", "ORCA", "IBIS", 2, 3),
]


def asked_for(spark, home, away, day, season=20242025, book=BOOK, cap=14):
    games = spark.createDataFrame(book, SCHEMA)
    asked = spark.createDataFrame([game(99, day, home, away, None, None, season=season, state="FUT")], SCHEMA)
    return history.score_features(games, asked, cap).first().asDict()


def test_four_results_of_one_team(spark):
    row = asked_for(spark, "LYNX", "WOLF", "2024-11-12")
    want = {
        "last_5_win_pct": 0.5, "last_5_goals_for_avg": 3.0, "last_5_goals_against_avg": 3.0, "rest_days": 1.0, "back_to_back": 1.0,
        "games_last_3_days": 1.0, "games_last_7_days": 3.0, "games_last_14_days": 4.0, "home_win_pct_before_game": 0.5,
        "road_win_pct_before_game": 0.5, "home_goal_diff_avg_before_game": -1.0, "road_goal_diff_avg_before_game": 1.0,
        "season_points_pct_before_game": 0.5, "goal_diff_last_10": 0.0,
    }
    assert {k: row[f"home_{k}"] for k in want} == want
    assert row["away_last_5_win_pct"] is None and row["away_games_last_14_days"] == 0.0


def test_shuffled_input_gives_the_same_rows(spark):
    book = [BOOK[i] for i in (3, 0, 4, 2, 1)]
    assert asked_for(spark, "IBIS", "ORCA", "2024-11-20", book=book) == asked_for(spark, "IBIS", "ORCA", "2024-11-20")


def test_own_date_is_never_seen(spark):
    on_the_day = asked_for(spark, "ORCA", "IBIS", "2024-11-12")
    assert (on_the_day["home_last_5_win_pct"], on_the_day["away_last_5_win_pct"]) == (0.5, 0.5)
    day_after = asked_for(spark, "ORCA", "IBIS", "2024-11-13")
    assert (day_after["home_last_10_win_pct"], day_after["away_last_10_win_pct"]) == (pytest.approx(0.3333), pytest.approx(0.6667))


def test_nothing_is_known_of_a_first_game(spark):
    row = asked_for(spark, "ORCA", "LYNX", "2024-11-02")
    unknown = ("rest_days", "last_5_win_pct", "season_points_pct_before_game", "home_win_pct_before_game")
    assert [row[f"{s}_{c}"] for s in ("home", "away") for c in unknown] == [None] * 8
    assert (row["home_back_to_back"], row["away_games_last_3_days"]) == (0.0, 0.0)


def test_season_records_end_with_the_season_but_form_does_not(spark):
    row = asked_for(spark, "LYNX", "IBIS", "2025-10-09", season=20252026)
    assert (row["home_season_points_pct_before_game"], row["away_home_win_pct_before_game"]) == (None, None)
    assert row["home_last_5_win_pct"] == 0.5 and row["away_last_5_win_pct"] == pytest.approx(0.6667)


@pytest.mark.parametrize(("cap", "days"), [(None, 221), (14, 14), (30, 30)])
def test_long_rest(spark, cap, days):
    assert asked_for(spark, "LYNX", "IBIS", "2025-06-20", cap=cap)["home_rest_days"] == days


@pytest.mark.parametrize(
    ("home", "away", "games", "share", "diff"),
    [("IBIS", "ORCA", 1, 1.0, 1.0), ("ORCA", "IBIS", 1, 0.0, -1.0), ("LYNX", "ORCA", 2, 0.5, -1.0), ("LYNX", "WOLF", 0, None, None)],
)
def test_earlier_meetings(spark, home, away, games, share, diff):
    asked = spark.createDataFrame([game(99, "2024-11-14", home, away, None, None, state="FUT")], SCHEMA)
    row = matchups.head_to_head(spark.createDataFrame(BOOK, SCHEMA), asked).first()
    got = (row["h2h_games_last_365_days"], row["h2h_home_team_win_pct_last_5"], row["h2h_home_team_goal_diff_avg_last_5"])
    assert got == (games, share, diff)


def test_marks_of_the_last_results(spark):
    extra = game(16, "2024-11-15", "LYNX", "IBIS", 2, 3, "SO")
    rows = history.team_games(spark.createDataFrame([*BOOK, extra], SCHEMA))
    with_extra_time = {r["team"]: r["form"] for r in board.last_form(rows, ["team"], overtime=True).collect()}
    assert with_extra_time == {"LYNX": "W,W,L,L,O", "IBIS": "L,W,W,W", "ORCA": "L,W,L"}
    plain = {r["team"]: r["form"] for r in board.last_form(rows, ["team"], n=2).collect()}
    assert plain == {"LYNX": "L,L", "IBIS": "W,W", "ORCA": "W,L"}


def test_many_games_on_one_day(spark):
    """Twelve games on one date: only the last ten by id count, none of them on the date itself."""
    book = [game(i, "2025-10-01", "A", f"B{i}", 1 if i > 2 else 3, 2) for i in range(1, 13)]
    row = asked_for(spark, "A", "C", "2025-10-02", book=book)
    assert row["home_last_10_win_pct"] == 0.0 and row["home_season_points_pct_before_game"] == pytest.approx(0.1667)
    assert asked_for(spark, "A", "C", "2025-10-01", book=book)["home_last_10_win_pct"] is None


def test_differences_cover_every_declared_pair(spark):
    assert len(history.diff_pairs()) == 34 and len(history.TEAM_FEATURES) == 38
    games = spark.createDataFrame(BOOK, SCHEMA)
    made = history.with_differences(history.score_features(games))
    row = made.filter("game_id = 14").first()
    assert row["season_points_pct_diff"] == pytest.approx(0.6667)
    assert row["home_ice_split_win_pct_diff"] is None  # the visitors have no road game yet


def test_serving_differences_use_both_spellings(spark):
    df = spark.range(1).select(
        F.lit(0.6).alias("home_season_points_pct_before_game"), F.lit(0.5).alias("away_season_points_pct_before_game"),
        F.lit(3.0).alias("home_rest_days"), F.lit(1.0).alias("away_rest_days"),
    )
    row = serving.inferred_differences(df, ["season_points_pct_diff", "rest_days_diff", "hits_diff"]).first()
    assert row["season_points_pct_diff"] == pytest.approx(0.1) and row["rest_days_diff"] == 2.0
    assert "hits_diff" not in row.asDict()


def test_ten_digit_ids_name_their_series(spark):
    book = [game(2025030111 + i, f"2026-05-0{i + 1}", "A" if i % 2 else "B", "B" if i % 2 else "A", 2, 1, kind=3) for i in range(4)]
    rows = matchups.series_state(spark.createDataFrame(book, SCHEMA)).orderBy("game_id").collect()
    assert [r["playoff_series_game_number"] for r in rows] == [1, 2, 3, 4]
    assert [(r["home_series_wins_before"], r["away_series_wins_before"]) for r in rows] == [(0, 0), (0, 1), (1, 1), (1, 2)]
