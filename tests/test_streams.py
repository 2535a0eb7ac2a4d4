"""Streams over several micro-batches against batch results on hand fixtures."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tallyline.operators import live, models, ratings
from tallyline.plans import catalog_streams
from tallyline.sources import standin
from tallyline.streaming import games, late
from tallyline.streaming import live as streams

START = dt.datetime(2024, 1, 1, 12, 0)
PLAYS = (
    "game_id long, event_id long, sort_order long, event_type string, side string, situation_code string, seconds_elapsed long, "
    "penalty_minutes long, goalie_in_net_id long, home_score_event long, away_score_event long, fed_at timestamp, part int"
)


def play(game, n, kind, side="home", part=0, code="1551", minutes=None, goalie=None, stated=(None, None), minute=None):
    at = START + dt.timedelta(minutes=n if minute is None else minute)
    return (game, n, n, kind, side, code, n * 60, minutes, goalie, *stated, at, part)


BOOK = [
    play(1, 1, "faceoff"), play(1, 2, "penalty", "away", minutes=2), play(1, 3, "shot-on-goal", code="1451", goalie=31),
    # arrives a file late, but within ten minutes
    play(1, 4, "goal", code="1451", part=1, stated=(1, 0)), play(1, 6, "goal", "away", goalie=30), play(1, 7, "penalty", "home", minutes=5, part=1),
    play(1, 9, "goal", "away", part=1, code="1541", stated=(1, 3)), play(1, 12, "blocked-shot", "away", part=1),
    play(2, 5, "hit"), play(2, 30, "giveaway", "away", part=1), play(2, 31, "goal", part=2, goalie=0), play(2, 33, "takeaway", None, part=2),
    play(3, 40, "missed-shot", part=2), play(3, 41, "goal", code="0641", part=2),
]
COLUMNS = ["game_id", "event_index", "event_id", *games.COUNTERS, *games.SCORES, *games.GOALIES, *games.PENALTIES, "score_diff_home", "manpower_diff_home", "home_goalie_save_pct_live"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: r[:2])


def batch_rows(plays):
    events = live.GameEvents(plays.drop("part", "fed_at"))
    return rows_of(live.running_state(events).join(live.active_penalties(events), ["game_id", "event_index"]))


def test_streamed_state_rows_equal_the_batch(spark, tmp_path):
    book = spark.createDataFrame(BOOK, PLAYS)
    games.write_replay(book, str(tmp_path / "in"), 3)
    stream = games.read_replay(spark, str(tmp_path / "in"), book.drop("part").schema)
    sizes = []

    def each(rows):
        sizes.append(rows.count())
        return games.derived(rows)

    made = games.run_states(spark, stream, each, idle_minutes=60)
    assert rows_of(made) == batch_rows(book)
    # rows come as the watermark passes them, in several micro-batches
    assert sum(s > 0 for s in sizes) >= 3


def test_idle_games_end_and_start_anew(spark, tmp_path):
    rows = [play(1, 1, "goal"), play(1, 2, "shot-on-goal"), play(9, 90, "hit", part=1), play(1, 200, "goal", part=2)]
    book = spark.createDataFrame(rows, PLAYS)
    games.write_replay(book, str(tmp_path / "in"), 3)
    stream = games.read_replay(spark, str(tmp_path / "in"), book.drop("part").schema)
    made = {(r["game_id"], r["event_id"]): (r["event_index"], r["home_score"]) for r in games.run_states(spark, stream, idle_minutes=30).collect()}
    # the state of game 1 was dropped after half an hour without plays: its later play opens a new one
    assert made == {(1, 1): (1, 1), (1, 2): (2, 1), (9, 90): (1, 0), (1, 200): (1, 1)}


def test_game_state_survives_storage():
    game = games.Game()
    named = [dict(zip(games.PLAY.names, p, strict=True)) for p in (
        (0, 1, 1, "penalty", "home", "1551", None, 10, 2.0, None, None, None), (1, 2, 2, "penalty", "away", "1541", "home", 20, 5.0, None, None, None),
        (2, 3, 3, "goal", "home", "1541", "home", 30, None, 7, None, 2),
    )]
    for p in named[:2]:
        game.play(p)
    again = games.Game(game.held())
    game.play(named[2])
    again.play(named[2])
    assert game.row(1, named[2]) == again.row(1, named[2]) and game.held() == again.held()
    assert again.n["away_score"] == 2 and again.n["away_goalie_id"] == 7 and again.n["home_power_play_opportunities"] == 1


def test_detailed_plays_have_every_kind(spark, sf):
    kinds = {r[0] for r in standin.detailed_plays(spark, sf).select("event_type").distinct().collect()}
    assert kinds >= {"goal", "shot-on-goal", "missed-shot", "blocked-shot", "hit", "giveaway", "takeaway", "faceoff", "penalty"}
    assert standin.detailed_plays(spark, sf).filter(F.col("fed_at").isNull()).count() == 0


def test_rows_too_late_land_in_the_side_table_and_no_row_is_lost(spark, tmp_path):
    rows = [
        play(1, 1, "faceoff"), play(1, 2, "goal"), play(2, 30, "hit"),
        # the line is at minute 20: minute 3 is too late, minute 25 is not
        play(1, 3, "goal", part=1), play(2, 25, "goal", part=1), play(2, 31, "goal", part=1), play(1, 60, "hit", part=1),
        # the line is at minute 50 and never moves back
        play(1, 40, "goal", part=2), play(3, 51, "goal", part=2), play(3, 49, "hit", part=2),
    ]
    book = spark.createDataFrame(rows, PLAYS)
    games.write_replay(book, str(tmp_path / "in"), 3)
    schema = book.drop("part").schema
    folder, progress = str(tmp_path / "split"), str(tmp_path / "progress")
    for _ in range(2):  # a second run finds nothing new
        late.split_late(spark, games.read_replay(spark, str(tmp_path / "in"), schema), out=folder, progress=progress)
    aside = late.late_rows(spark, folder, book.drop("part").schema)
    assert sorted((r["event_id"], r["batch"]) for r in aside.collect()) == [(3, 1), (40, 2), (49, 2)]
    sessions = late.run_sessions(spark, late.rows_in_time(spark, folder, schema, per_trigger=1), "3 minutes").collect()
    got = sorted((r["game_id"], (r["starts"] - START).seconds // 60, (r["ends"] - START).seconds // 60, r["plays"], r["goals"]) for r in sessions)
    assert got == [(1, 1, 5, 2, 1), (1, 60, 63, 1, 0), (2, 25, 28, 1, 1), (2, 30, 34, 2, 1), (3, 51, 54, 1, 1)]
    assert sum(s[3] for s in got) + aside.count() == len(rows)


def some_games(n, pools=2):
    rng, rows = random.Random(5), []
    for i in range(n):
        home, away = rng.sample(range(6), 2)
        hs, as_ = rng.randrange(6), rng.randrange(6)
        day = dt.date(2024, 6, 1) + dt.timedelta(days=i // 4)
        season = 20232024 if day < dt.date(2024, 8, 1) else 20242025
        rows.append((i % pools, i + 1, season, day, 2, "OFF", home, away, hs + (hs == as_), as_, "REG"))
    return rows


GAMES = (
    "pool long, game_id long, season long, game_date date, game_type long, game_state string, home_team long, away_team long, "
    "home_score long, away_score long, last_period_type string"
)


@pytest.mark.parametrize("snapshots", [1, 8])
def test_late_games_and_split_dates_give_the_ratings_of_a_whole_replay(spark, tmp_path, snapshots):
    rows = some_games(400)
    scheduled = [(*rows[7][:5], "FUT", *rows[7][6:])]
    late_games = [r for r in rows if r[1] in (30, 121, 122)]
    in_time = [r for r in rows if r not in late_games]
    # the second file starts in the middle of a date, the third brings games of weeks before and some again
    files = [in_time[:101] + scheduled, in_time[101:250], late_games + in_time[90:120] + in_time[250:], rows[:50] + rows[-3:]]
    folders = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], GAMES).schema, per_trigger=1)
        made = streams.rating_stream(spark, stream, *folders, snapshots=snapshots)
        return {(r["pool"], r["team"]): (r["season"], r["elo"], r["decay_gd"]) for r in made.collect()}

    want = {(r["pool"], r["team"]): (r["season"], r["elo"], r["decay_gd"]) for r in ratings.team_states(spark.createDataFrame(rows, GAMES)).collect()}
    for i, part in enumerate(files):
        spark.createDataFrame(part, GAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
        if i in (1, 3):
            got = run()  # the second run resumes the first
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    assert spark.read.parquet(folders[0] + "/games").count() == len(rows)


def test_a_game_a_week_late_leaves_snapshots_before_it(spark, tmp_path):
    rows = some_games(400)  # a hundred days
    # the last game of the second file has no date: it comes before all others and voids all snapshots
    undated = (*rows[3][:1], 900, 20232024, None, *rows[3][4:])
    late_game = next(r for r in rows if r[0] == 0 and r[3] == dt.date(2024, 8, 1))
    files = [[r for r in rows[:280] if r != late_game], [late_game, *rows[280:330]], [*rows[330:], undated]]
    folders = str(tmp_path / "out"), str(tmp_path / "progress")
    before = []
    for i, part in enumerate(files):
        spark.createDataFrame(part, GAMES).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
        stream = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], GAMES).schema, per_trigger=1)
        made = streams.rating_stream(spark, stream, *folders)
        want = {(r["pool"], r["team"]): (r["season"], r["elo"]) for r in ratings.team_states(spark.createDataFrame(sum(files[: i + 1], []), GAMES)).collect()}
        assert {(r["pool"], r["team"]): (r["season"], r["elo"]) for r in made.collect()} == want
        held = spark.read.parquet(f"{folders[0]}/states/batch={i}").filter("pool = 0").select("as_of").distinct().collect()
        before.append(sorted(r["as_of"] for r in held))
    # the first file ends on August 9, so its snapshots of July 25 and earlier outlive the late game and are folded on
    assert before[0][-1] == dt.date(2024, 8, 9) and dt.date(2024, 7, 25) in before[0]
    assert before[1][-1] > before[0][-1] and {d for d in before[0] if d < dt.date(2024, 8, 1)} & set(before[1])


def test_states_as_of_marked_dates_are_those_of_the_games_up_to_them(spark):
    rows = some_games(200)
    book = spark.createDataFrame(rows, GAMES)
    days = [dt.date(2024, 6, 3), dt.date(2024, 7, 1)]
    marks = spark.createDataFrame([(p, d) for p in (0, 1) for d in days], "pool long, as_of date")
    made = {(r["pool"], r["as_of"], r["team"]): (r["season"], r["elo"], r["decay_gd"], r["decay_win"]) for r in ratings.dated_states(book, None, marks).collect()}
    for day in [*days, max(r[3] for r in rows)]:
        want = ratings.team_states(book.filter(F.col("game_date") <= F.lit(day))).collect()
        assert {k[::2]: v for k, v in made.items() if k[1] == day} == {(r["pool"], r["team"]): (r["season"], r["elo"], r["decay_gd"], r["decay_win"]) for r in want}
    assert {k[1] for k in made} == {*days, max(r[3] for r in rows)}


def test_streamed_probabilities_equal_the_batch_and_carry_the_version(spark, tmp_path):
    book = spark.createDataFrame(BOOK, PLAYS)
    preds = spark.createDataFrame([(1, 0.6, 2), (2, 0.4, 3)], "game_id long, p_home double, game_type long")
    events = live.GameEvents(book.drop("part", "fed_at"))
    state = catalog_streams.model_rows(live.running_state(events).join(live.active_penalties(events), ["game_id", "event_index"]), preds)
    features, registry = list(models.LIVE_FEATURES), str(tmp_path / "registry")
    for version, label in ((3, F.col("event_id") % 2), (4, F.col("event_index") % 2)):
        fitted = models.fit_all({"logit": models.logistic_member(features, 14)}, state.withColumn("y", label.cast("long")), features)
        models.publish(fitted, features, spark, registry, version)
    games.write_replay(book, str(tmp_path / "in"), 3)
    for version in (None, 3):
        stream = games.read_replay(spark, str(tmp_path / "in"), book.drop("part").schema)
        made = games.run_scored(spark, stream, registry, lambda rows: catalog_streams.model_rows(rows, preds), version)
        got = {(r["game_id"], r["event_id"]): r["p"] for r in made.filter(F.col("version") == (version or 4)).collect()}
        loaded, order, number = models.load_version(spark, registry, version)
        assert number == (version or 4) and order == features
        want = {(r["game_id"], r["event_id"]): r["p"] for r in models.ensemble(loaded, state, features, "p").collect()}
        assert len(want) == len(BOOK) and got == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        models.load_version(spark, registry, 9)


class Kept:
    """State of one game as the processor's handle gives it, and the calls it took."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, minute):
        self.at = minute * 60_000

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_game_costs_few_state_calls_and_ends_without_a_batch_in_between():
    kept, tracker = Kept(), games.GameTracker(30)
    tracker.init(kept)
    goal = lambda minute, n: (minute * 60_000_000, n, n, "goal", "home", "1551", None, 60 * n, None, None, None, None)
    assert list(tracker.go_on((7,), [goal(m, m) for m in range(1, 60)], Clock(0))) == []
    # one read, one write and one timer, however many plays wait
    assert kept.calls == 3 and kept.timers == {60_001}
    out = list(tracker.go_on((7,), [goal(200, 200)], Clock(80)))
    assert len(out) == 1 and len(out[0]) == 59 and out[0].shape[1] <= 6
    # the play at minute 200 waits; the game had ended by then, though its state is still there
    (last,) = tracker.go_on((7,), [], Clock(210), expired=True)
    assert last["whole"][0][games._WHOLE.index("event_index")] == 1 and last["whole"][0][games._WHOLE.index("home_score")] == 1
    assert kept.value is not None
    list(tracker.go_on((7,), [], Clock(300), expired=True))
    assert kept.value is None
