"""Ratings, in-game state, flattening, sources, models and streams on small fixtures."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators import history, live, models, ratings
from tallyline.sources import flatten, landing
from tallyline.streaming import live as streams

GAMES = (
    "pool long, game_id long, season long, game_date date, game_type long, game_state string, home_team long, away_team long, "
    "home_score long, away_score long, last_period_type string"
)


def some_games(n=120, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        home, away = rng.sample(range(6), 2)
        hs, as_ = rng.randrange(6), rng.randrange(6)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=3 * i)
        season = 20232024 if day < dt.date(2024, 8, 1) else 20242025
        rows.append((0, i + 1, season, day, 3 if i % 17 == 0 else 2, "OFF", home, away, hs + (hs == as_), as_, "REG"))
    return rows


def by_hand(rows):
    """The rating recurrence written out for the check."""
    import math

    state, out = {}, {}
    for _, gid, season, _, kind, _, h, a, hs, as_, _ in rows:
        for t in (h, a):
            if t not in state:
                state[t] = [1505.0, 0.0, 0.5, season]
            elif state[t][3] != season:
                r, g, w, _ = state[t]
                state[t] = [1505 + (r - 1505) * 0.7, g * 0.5, 0.5 + (w - 0.5) * 0.5, season]
        gap = state[h][0] + 50 - state[a][0]
        p = 1 / (10 ** (-gap / 400) + 1)
        out[gid] = (state[h][0], state[a][0], p, state[h][1], state[a][2])
        won, d = int(hs > as_), hs - as_
        k = 6 * (1.25 if kind == 3 else 1)
        shift = k * (0.6686 * math.log(max(abs(d), 1)) + 0.8048) * (2.05 / ((gap if won else -gap) * 0.001 + 2.05)) * (won - p)
        for t, sign, y in ((h, 1, won), (a, -1, 1 - won)):
            state[t][0] += sign * shift
            state[t][1] = 0.95 * state[t][1] + 0.05 * sign * d
            state[t][2] = 0.95 * state[t][2] + 0.05 * y
    return out, state


def test_ratings_equal_the_recurrence(spark):
    rows = some_games()
    want, final = by_hand(rows)
    made = ratings.ratings(spark.createDataFrame(rows[::-1], GAMES)).collect()
    for r in made:
        got = (r["home_elo_pre"], r["away_elo_pre"], r["elo_prob_home"], r["home_decay_goal_diff"], r["away_decay_win_rate"])
        assert got == pytest.approx(want[r["game_id"]], abs=1e-9)
    states = {r["team"]: r["elo"] for r in ratings.team_states(spark.createDataFrame(rows, GAMES)).collect()}
    assert states == pytest.approx({t: s[0] for t, s in final.items()}, abs=1e-9)


def test_an_unbalanced_game_is_counted(spark):
    changes = ratings.rating_changes(spark.createDataFrame(some_games(), GAMES))
    n = len(some_games())
    assert tuple(ratings.unbalanced(changes).first()) == (n, 0)
    broken = changes.withColumn("away_after", F.col("away_after") + F.when(F.col("game_id") == some_games()[3][1], 0.5).otherwise(0.0))
    assert tuple(ratings.unbalanced(broken).first()) == (n, 1)


def test_catch_up_is_incremental_and_idempotent(spark):
    games = spark.createDataFrame(some_games(), GAMES)
    cut = dt.date(2024, 9, 1)
    saved = ratings.team_states(games.filter(F.col("game_date") <= F.lit(cut)))
    now = ratings.catch_up(saved, games, cut)
    full = {r["team"]: r["elo"] for r in ratings.team_states(games).collect()}
    assert {r["team"]: r["elo"] for r in now.collect()} == pytest.approx(full, abs=1e-9)
    again = ratings.catch_up(now, games, dt.date(2030, 1, 1))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, now.collect()))


def test_season_change_happens_once(spark):
    states = spark.createDataFrame([(0, 1, 20232024, 1605.0, 2.0, 0.7)], "pool long, team long, season long, elo double, decay_gd double, decay_win double")
    once = ratings.enter_season(states, 20242025)
    row = once.first()
    assert (row["elo"], row["decay_gd"], row["decay_win"]) == pytest.approx((1575.0, 1.0, 0.6))
    assert ratings.enter_season(once, 20242025).first() == row


@pytest.mark.parametrize("block", [1, 3, 7, 20, 512])
def test_decayed_form_equals_the_recurrence(spark, block):
    rows = some_games()
    want, _ = by_hand(rows)
    made = ratings.decayed_form(history.team_games(spark.createDataFrame(rows, GAMES)), block=block)
    home = {r[1]: r[6] for r in rows}
    for r in made.collect():
        if r["team"] == home[r["game_id"]]:
            assert r["decay_goal_diff"] == pytest.approx(want[r["game_id"]][3], abs=1e-9)


PLAYS = "game_id long, event_id long, sort_order long, event_type string, side string, situation_code string, seconds_elapsed long, penalty_minutes double, goalie_in_net_id long, home_score_event long, away_score_event long"


def state_of(spark, rows):
    events = live.GameEvents(spark.createDataFrame([(1, i + 1, i + 1, *r) for i, r in enumerate(rows)], PLAYS))
    return events, live.running_state(events).orderBy("event_index").collect()


def test_stated_scores_and_goal_counts(spark):
    goal = lambda side, h=None, a=None: ("goal", side, "1551", 10, None, 30, h, a)
    _, rows = state_of(spark, [goal("home"), goal("home", 5, 0), goal("away", None, 0), goal("home", 0, None), goal("away", 9, 4)])
    assert [(r["home_score"], r["away_score"]) for r in rows] == [(1, 0), (5, 0), (5, 1), (6, 1), (9, 4)]
    assert [r["home_sog"] for r in rows] == [1, 2, 2, 3, 3]
    assert rows[-1]["away_goalie_goals_against"] == 3 and rows[0]["away_goalie_id"] == 30


def test_blocks_count_as_attempts_in_play(spark):
    _, rows = state_of(spark, [("blocked-shot", "home", "1551", 5, None, None, None, None), ("missed-shot", "away", "1551", 6, None, None, None, None)])
    last = rows[-1]
    assert (last["home_shot_attempts"], last["away_blocks"], last["home_blocked_shots_for"], last["away_missed_shots"]) == (1, 1, 1, 1)


def test_penalties_expire_and_goals_release_the_oldest_minor(spark):
    rows = [
        ("penalty", "away", "1551", 0, 5.0, None, None, None),   # major until 300
        ("penalty", "away", "1451", 30, 2.0, None, None, None),  # minor until 150
        ("penalty", "away", "1451", 40, 2.0, None, None, None),  # minor until 160
        ("goal", "home", "1451", 50, None, None, None, None),    # releases the minor of 30
        ("faceoff", "home", "1451", 160, None, None, None, None),  # the minor of 40 has run out
        ("faceoff", "home", "1551", 300, None, None, None, None),
    ]
    events, state = state_of(spark, rows)
    got = {r["event_index"]: (r["away_active_penalties"], r["away_active_penalty_seconds"]) for r in live.active_penalties(events).collect()}
    assert got == {1: (1, 300), 2: (2, 390), 3: (3, 490), 4: (2, 360), 5: (1, 140), 6: (0, 0)}
    assert state[3]["home_power_play_goals"] == 1 and state[-1]["home_power_play_opportunities"] == 1


def test_outcome_is_hidden_until_final(spark):
    df = spark.createDataFrame([("LIVE", 2, 1), ("OFF", 2, 1)], "game_state string, home_final_score long, away_final_score long")
    assert [tuple(r)[1:] for r in live.expose_outcome(df, False).collect()] == [(None, None, None), (2, 1, None)]
    assert live.expose_outcome(df, True).first()["target_home_win"] == 1


def test_pregame_row_for_games_without_plays(spark):
    games = spark.createDataFrame([(1,), (2,)], "game_id long")
    plays = spark.createDataFrame([(1,)], "game_id long")
    rows = live.pregame_rows(games, plays).collect()
    assert [(r["game_id"], r["home_score"], r["event_type"]) for r in rows] == [(2, 0, "pregame")]


def test_documents_from_files(spark, tmp_path):
    folder = tmp_path / "20252026" / "7"
    folder.mkdir(parents=True)
    play = {
        "eventId": 3, "sortOrder": 1, "typeDescKey": "penalty", "timeInPeriod": "01:05", "periodDescriptor": {"number": 2},
        "details": {"eventOwnerTeamId": 10, "servedByPlayerId": 9, "committedByPlayer": {"playerId": 4}, "duration": 2, "descKey": "hooking"},
    }
    doc = {"id": 7, "season": 20252026, "homeTeam": {"id": 10, "abbrev": "TOR"}, "awayTeam": {"id": 8, "abbrev": "MTL"}, "plays": [play]}
    (folder / "play_by_play.json").write_text(json.dumps(doc, indent=1))
    schema = T._parse_datatype_string(flatten.PLAY_BY_PLAY) if hasattr(T, "_parse_datatype_string") else flatten.PLAY_BY_PLAY
    docs = landing.read_documents(spark, str(tmp_path), schema)
    parts = landing.path_parts(docs.select("path")).first()
    assert (parts["season"], parts["game_id"], parts["artifact"]) == (20252026, 7, "play_by_play")
    row = flatten.play_rows(docs).first()
    assert (row["team"], row["team_side"], row["seconds_elapsed"], row["player_1"], row["player_2"]) == ("TOR", "home", 1265, 9, 4)
    assert row["reason"] == "hooking" and row["description"] == "hooking event_id=3" and row["assist1_player_id"] is None
    assert json.loads(row["raw_details_json"]) == play["details"]


def test_future_games_carry_no_score(spark):
    game = {"id": 1, "gameDate": "2026-10-01", "gameState": "FUT", "homeTeam": {"abbrev": "A", "score": 0}, "awayTeam": {"abbrev": "B", "score": 0}}
    docs = spark.createDataFrame([(json.dumps({"gameWeek": [{"games": [game]}]}),)], "text string")
    rows = flatten.games_of(docs.select(F.from_json("text", flatten.SCHEDULE).alias("d")).select("d.*"), [])
    row = flatten.flatten_serving_game(rows).first()
    assert row["home_score"] is None and row["finished"] is False
    assert flatten.flatten_game(rows).first()["home_win"] is None


def test_tables_are_conformed_and_optional(spark, tmp_path):
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])
    assert landing.load_table(spark, str(tmp_path / "none"), schema).count() == 0
    landing.save_table(spark.createDataFrame([("x", 1)], "a string, extra long"), str(tmp_path / "t"), schema)
    assert [tuple(r) for r in landing.load_table(spark, str(tmp_path / "t"), schema).collect()] == [(None, "x")]
    landing.write_sections({"one": spark.range(2)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def training(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i // 4)
        rows.append((i, 20232024, day, 2, float(rng.random() < 1 / (1 + 2.718 ** -(1.5 * x))), x, None if i % 9 == 0 else z))
    return spark.createDataFrame(rows, "game_id long, season long, game_date date, game_type long, y double, f1 double, f2 double")


def test_walk_forward_trains_on_earlier_months_only(spark):
    df = training(spark)
    assert models.feature_columns(df) == ["f1", "f2"]  # never the outcome
    made = models.walk_forward(df, ["f1", "f2"], [20232024], lambda cols, n: {"logit": models.logistic_member(cols, n)}, min_train=100)
    months = {r["game_date"].month for r in made.collect()}
    assert months == {2, 3, 4}  # January has no earlier games
    assert made.filter("p_home < 0 or p_home > 1 or p_home is null").count() == 0


def test_the_training_table_has_exactly_the_expected_inputs(spark, sf):
    from tallyline.plans.catalog_ratings import model_dataset

    made = model_dataset(spark, sf)
    features = models.feature_columns(made)
    assert len(features) == len(set(features)) == 127
    assert len(live.STATE_COLUMNS) == len(set(live.STATE_COLUMNS)) == 98
    assert "elo_pre" in models.mirrored(features) and "rest_days" not in models.mirrored(features, ("rest_days",))


def test_registry_round_trip(spark, tmp_path):
    df = training(spark, 200)
    features = ["f1", "f2"]
    fitted = models.fit_all({"logit": models.logistic_member(features, 200), "hgb": models.boosted_member(features, models.BOOSTED | {"minInstancesPerNode": 5}, 3)}, df, features)
    states = spark.createDataFrame([(0, 1, 1505.0)], "pool long, team long, elo double")
    models.save_registry(fitted, features, states, str(tmp_path / "registry"))
    loaded, order, kept = models.load_registry(spark, ["logit", "hgb"], str(tmp_path / "registry"))
    assert order == features and kept.count() == 1
    a = [r["p_home"] for r in models.ensemble(fitted, df, features).orderBy("game_id").collect()]
    b = [r["p_home"] for r in models.ensemble(loaded, df, features).orderBy("game_id").collect()]
    assert a == pytest.approx(b)


def test_stream_puts_late_plays_in_place(spark, tmp_path):
    """Three files in order; the second holds a play older than one already seen, the last one only moves time on."""
    schema = "game_id long, event_id long, ts timestamp, event_type string, side string, penalty_minutes long"
    at = lambda m: dt.datetime(2024, 1, 1, 12, m)
    files = [
        [(1, 1, at(0), "goal", "home", None), (1, 3, at(8), "goal", "away", None)],
        [(1, 2, at(5), "penalty", "home", 2)],
        [(1, 4, at(40), "shot-on-goal", "home", None)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    stream = streams.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, per_trigger=1)
    row = streams.latest_game_states(spark, stream).first()
    assert (row["event_index"], row["event_id"]) == (4, 4)
    assert (row["home_score"], row["away_score"], row["home_penalty_minutes"], row["home_sog"]) == (1, 1, 2, 2)


def test_games_delivered_again_are_not_counted_and_a_second_run_adds_nothing(spark, tmp_path):
    rows = some_games(60)
    for i, part in enumerate((rows[:40], rows[20:])):
        spark.createDataFrame(part, GAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    folders = str(tmp_path / "states"), str(tmp_path / "progress")

    def run():
        stream = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], GAMES).schema, per_trigger=1)
        return {r["team"]: r["elo"] for r in streams.rating_stream(spark, stream, *folders).collect()}

    want = {r["team"]: r["elo"] for r in ratings.team_states(spark.createDataFrame(rows, GAMES)).collect()}
    assert run() == pytest.approx(want, abs=1e-9)
    assert run() == pytest.approx(want, abs=1e-9)
