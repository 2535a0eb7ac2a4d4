"""Registered queries over replays: streams of several micro-batches, and the batch results they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contest
from ..operators import live, models
from ..session import materialise, scratch_path
from ..sources import standin
from ..streaming import games, late
from ..streaming import live as live_streams
from .catalog_live import SIT, SQL_PENALTIES, W
from .catalog_models import SQL_STREAM_RATINGS
from .catalog_scores import rnd
from .views_sql import with_views

# files of a replay, and how late every seventh play is delivered, in seconds
FILES, LATE_BY = 4, 300

COUNTED = [f"{s}_{n}" for n in live.COUNTERS for s, _ in live.SIDES]
SHOWN = ["home_score", "away_score", "home_goalie_id", "away_goalie_id", "score_diff_home", "hit_diff_home", "faceoff_win_diff_home"]


def _out(df, more=()):
    ints = [*COUNTED, *SHOWN, *more]
    return df.select(
        "game_id", "event_id", F.col("event_index").cast("long").alias("event_index"), "event_type", *[F.col(c).cast("long").alias(c) for c in ints],
        "home_goalie_save_pct_live", "away_goalie_save_pct_live",
    )


def detailed_counters(spark, folder):
    """All counters, stated scores and goalies after every play; games with an even id name their starters."""
    plays = standin.detailed_plays(spark, folder).drop("fed_at", "fed_second")
    even = plays.filter(F.col("game_id") % 2 == 0).select("game_id").distinct()
    starters = even.select("game_id", (500 + F.col("game_id") % 7).alias("home_starter"), (600 + F.col("game_id") % 5).alias("away_starter"))
    return _out(live.running_state(live.GameEvents(plays), starters))


def _count(condition: str, name: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) {W} AS BIGINT) AS {name}"


def _sides() -> str:
    out = []
    for own, other, hi, lo in (("home", "away", "hsk", "ask"), ("away", "home", "ask", "hsk")):
        mine, theirs = f"side = '{own}'", f"side = '{other}'"
        on_goal = "event_type IN ('shot-on-goal', 'goal')"
        out += [
            _count(f"{on_goal} AND {mine}", f"{own}_sog"),
            _count(f"event_type IN ('shot-on-goal', 'missed-shot', 'blocked-shot', 'goal') AND {mine}", f"{own}_shot_attempts"),
            _count(f"event_type = 'missed-shot' AND {mine}", f"{own}_missed_shots"), _count(f"event_type = 'blocked-shot' AND {mine}", f"{own}_blocked_shots_for"),
            _count(f"event_type = 'blocked-shot' AND {theirs}", f"{own}_blocks"), _count(f"event_type = 'hit' AND {mine}", f"{own}_hits"),
            _count(f"event_type = 'giveaway' AND {mine}", f"{own}_giveaways"), _count(f"event_type = 'takeaway' AND {mine}", f"{own}_takeaways"),
            _count(f"event_type = 'faceoff' AND {mine}", f"{own}_faceoff_wins"), _count(f"event_type = 'penalty' AND {mine}", f"{own}_penalties"),
            f"CAST(SUM(CASE WHEN event_type = 'penalty' AND {mine} THEN penalty_minutes ELSE 0 END) {W} AS BIGINT) AS {own}_penalty_minutes",
            _count(f"edge = '{own}' AND edge IS DISTINCT FROM before", f"{own}_power_play_opportunities"),
            _count(f"event_type = 'goal' AND {mine} AND {hi} > {lo}", f"{own}_power_play_goals"),
            _count(f"event_type = 'goal' AND {mine} AND {hi} < {lo}", f"{own}_short_handed_goals"),
            _count(f"event_type = 'shot-on-goal' AND {theirs}", f"{own}_goalie_saves"), _count(f"event_type = 'goal' AND {theirs}", f"{own}_goalie_goals_against"),
            f"last_value(CASE WHEN {on_goal} AND {theirs} THEN nullif(goalie_in_net_id, 0) END IGNORE NULLS) {W} AS {own}_goalie",
            f"last_value(CASE WHEN {own}_said IS NOT NULL THEN {{'said': {own}_said, 'counted': {own}_counted}} END IGNORE NULLS) {W} AS {own}_stated",
        ]
    return ", ".join(out)


def _states(starter: bool) -> str:
    """CTEs up to ``made``: one row per play with all values after it."""
    said = ", ".join(f"CASE WHEN event_type = 'goal' THEN CASE WHEN side = '{s}' THEN nullif({s}_score_event, 0) ELSE {s}_score_event END END AS {s}_said" for s in ("home", "away"))
    counted = ", ".join(f"CAST(SUM(CASE WHEN event_type = 'goal' AND side = '{s}' AND {s}_said IS NULL THEN 1 ELSE 0 END) {W} AS BIGINT) AS {s}_counted" for s in ("home", "away"))
    score = ", ".join(f"coalesce({s}_stated.said + {s}_counted - {s}_stated.counted, {s}_counted) AS {s}_score" for s in ("home", "away"))
    start = {"home": "500 + game_id % 7", "away": "600 + game_id % 5"}
    goalie = ", ".join(f"coalesce({s}_goalie, CASE WHEN game_id % 2 = 0 THEN {start[s]} END) AS {s}_goalie_id" if starter else f"{s}_goalie AS {s}_goalie_id" for s in ("home", "away"))
    return f"""{SIT.replace("plays_v", "detailed_v")},
said AS (SELECT *, lag(edge) OVER (PARTITION BY game_id ORDER BY sort_order, event_id) AS before, {said} FROM pp),
counted AS (SELECT *, {counted} FROM said),
ran AS (SELECT game_id, event_id, sort_order, event_type, situation_code, hsk, ask, home_counted, away_counted,
  row_number() OVER (PARTITION BY game_id ORDER BY sort_order, event_id) AS event_index, {_sides()} FROM counted),
made AS (SELECT *, {score}, {goalie} FROM ran)"""


def _columns() -> str:
    saves = ", ".join(
        f"{rnd(f'CAST({s}_goalie_saves AS DOUBLE) / nullif({s}_goalie_saves + {s}_goalie_goals_against, 0)', 4)} AS {s}_goalie_save_pct_live" for s in ("home", "away")
    )
    return (
        f"game_id, event_id, event_index, event_type, {', '.join(COUNTED)}, home_score, away_score, home_goalie_id, away_goalie_id, "
        f"home_score - away_score AS score_diff_home, home_hits - away_hits AS hit_diff_home, home_faceoff_wins - away_faceoff_wins AS faceoff_win_diff_home, {saves}"
    )


SQL_DETAILED = with_views("plays_v detailed_v", f"{_states(True)} SELECT {_columns()} FROM made")

MORE = ["manpower_diff_home", "home_power_play", "away_power_play", "even_strength", *live.PENALTY_COLUMNS]


def replay(spark, folder, late_by: int = LATE_BY):
    """The stand-in plays as a replay of ``FILES`` files by time, every seventh play delivered ``late_by`` seconds late."""
    plays = standin.detailed_plays(spark, folder)
    delivered = F.col("fed_second") + F.when(F.col("event_id") % 7 == 0, late_by).otherwise(0)
    span = plays.agg((F.floor((F.max("fed_second") + F.lit(late_by)) / FILES) + 1).alias("_span"))
    parted = plays.join(F.broadcast(span)).withColumn("part", F.floor(delivered / F.col("_span")).cast("int")).drop("_span", "fed_second")  # one row
    parted = materialise(parted, "replay-rows")
    path = scratch_path(spark, "replay")
    games.write_replay(parted, path, FILES)
    return games.read_replay(spark, path, parted.drop("part").schema)


def stream_state_rows(spark, folder):
    """Final state rows of a replay over several files: counters, stated scores, manpower, penalties and goalies."""
    return _out(games.run_states(spark, replay(spark, folder)), MORE)


SQL_STATES = with_views(
    "plays_v detailed_v",
    f"""{_states(False)}, penalties AS ({SQL_PENALTIES})
SELECT {_columns()}, hsk - ask AS manpower_diff_home, CAST(hsk > ask AS BIGINT) AS home_power_play, CAST(ask > hsk AS BIGINT) AS away_power_play,
  CAST(hsk = ask AS BIGINT) AS even_strength, {', '.join(live.PENALTY_COLUMNS)} FROM made JOIN penalties USING (game_id, event_index)""",
)

# ---- sessions and late rows ---------------------------------------------------------------------------------------

# every seventh play is this late: beyond the delay where a file ends in between; a session breaks where a play is missing
TOO_LATE_BY, GAP = 2000, 70


def _split(spark, folder):
    plays = replay(spark, folder, TOO_LATE_BY)
    return plays, late.split_late(spark, plays)


def stream_sessions(spark, folder):
    """Sessions of the plays that came in time."""
    plays, split = _split(spark, folder)
    made = late.run_sessions(spark, late.rows_in_time(spark, split, plays.schema), f"{GAP} seconds")
    second = F.unix_timestamp("starts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return made.select("game_id", second.alias("starts"), (F.unix_timestamp("ends") - F.unix_timestamp("starts")).alias("seconds"), "plays", "goals", "least_event", "greatest_event")


def stream_late_rows(spark, folder):
    """The plays that came behind the line, with the micro-batch they came in."""
    plays, split = _split(spark, folder)
    return late.late_rows(spark, split, plays.schema).select("game_id", "event_id", "event_type", F.col("batch").cast("long").alias("batch"))


_LATE = f"""delivered AS (SELECT *, fed_second + CASE WHEN event_id % 7 = 0 THEN {TOO_LATE_BY} ELSE 0 END AS due FROM detailed_v),
parted AS (SELECT *, due // ((SELECT (MAX(fed_second) + {TOO_LATE_BY}) // {FILES} + 1 FROM detailed_v)) AS batch FROM delivered),
lines AS (SELECT batch, MAX(MAX(fed_second)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {late.DELAY_MINUTES * 60} AS line FROM parted GROUP BY batch),
judged AS (SELECT parted.*, coalesce(fed_second < line, false) AS late FROM parted JOIN lines USING (batch))"""
SQL_LATE_ROWS = with_views("plays_v detailed_v", f"{_LATE} SELECT game_id, event_id, event_type, CAST(batch AS BIGINT) AS batch FROM judged WHERE late")
SQL_SESSIONS = with_views(
    "plays_v detailed_v",
    f"""{_LATE},
opened AS (SELECT *, coalesce(fed_second - lag(fed_second) OVER (PARTITION BY game_id ORDER BY fed_second) >= {GAP}, true) AS fresh FROM judged WHERE NOT late),
numbered AS (SELECT *, SUM(fresh::INT) OVER (PARTITION BY game_id ORDER BY fed_second) AS session FROM opened)
SELECT game_id, CAST(MIN(fed_second) AS BIGINT) AS starts, CAST(MAX(fed_second) - MIN(fed_second) + {GAP} AS BIGINT) AS seconds, COUNT(*) AS plays,
  COUNT(*) FILTER (event_type = 'goal') AS goals, MIN(event_id) AS least_event, MAX(event_id) AS greatest_event FROM numbered GROUP BY game_id, session""",
)

# ---- scoring by a stored model --------------------------------------------------------------------------------------


def model_rows(state, preds):
    """State rows with the in-game model's inputs."""
    rows = models.live_rows(live.with_clock(state, F.lit(5)), preds)
    kinds = preds.select("game_id", (F.col("game_type") == 3).cast("int").alias("_playoff"))
    rows = rows.join(kinds, "game_id", "left").withColumn("is_playoff", F.coalesce("_playoff", F.lit(0))).drop("_playoff")
    return rows.withColumn("period", F.floor(F.col("seconds_elapsed") / 1200) + 1)


def train_and_publish(spark, folder, registry, version):
    """A logistic model of all in-game inputs, fitted on all plays of completed games."""
    events = live.GameEvents(materialise(standin.detailed_plays(spark, folder).drop("fed_at", "fed_second"), "live-plays"))
    state = live.running_state(events).join(live.active_penalties(events), ["game_id", "event_index"])
    preds = standin.predictions(spark, folder)
    known = preds.filter(contest.is_completed(F.col("game_state"))).select("game_id", "y")
    features = list(models.LIVE_FEATURES)
    rows = materialise(model_rows(state, preds).join(known, "game_id").select("y", *features), "live-train")
    models.publish(models.fit_all({"logit": models.logistic_member(features, rows.count())}, rows, features), features, spark, registry, version)


def stream_model_scoring(spark, folder):
    """Home win probability after every play of a replay, by the newest published model."""
    registry = scratch_path(spark, "registry")
    train_and_publish(spark, folder, registry, 1)
    preds = standin.predictions(spark, folder)
    scored = games.run_scored(spark, replay(spark, folder), registry, lambda rows: model_rows(rows, preds))
    return scored.select("game_id", "event_id", F.col("event_index").cast("long").alias("event_index"), "version", "p")


# ---- ratings from a feed with late games ---------------------------------------------------------------------------


def stream_late_ratings(spark, folder):
    """Team states from a feed of several files: dates split over two files, and games a week late."""
    orders = standin.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    half_days = 2 * F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) + F.col("o_orderkey") % 2
    due = half_days + F.when(F.col("o_orderkey") % 97 == 0, 14).otherwise(0)
    rows = orders.withColumn("_due", due)
    ends = rows.agg(F.min("_due").alias("_a"), F.max("_due").alias("_b"))
    # an odd number of half days, so that files end in the middle of a date
    width = (F.floor((F.col("_b") - F.col("_a")) / FILES / 2) * 2 + 1).alias("_w")
    parted = rows.join(F.broadcast(ends.select("_a", width)))  # one row
    parted = parted.withColumn("part", F.least(F.floor((F.col("_due") - F.col("_a")) / F.col("_w")), F.lit(FILES - 1)).cast("int")).drop("_due", "_a", "_w")
    parted = materialise(parted, "feed-rows")
    path = scratch_path(spark, "feed")
    games.write_parts(parted, path, FILES)
    fed = games.read_replay(spark, path, parted.drop("part").schema)
    made = live_streams.rating_stream(spark, standin.games_from(fed, standin.table(spark, folder, "customer")))
    return made.select("pool", "team", "season", *[(F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in ("elo", "decay_gd", "decay_win")])


QUERIES = {
    "stream_model_scoring": (stream_model_scoring, None),
    "stream_late_ratings": (stream_late_ratings, SQL_STREAM_RATINGS),
    "stream_sessions": (stream_sessions, SQL_SESSIONS),
    "stream_late_rows": (stream_late_rows, SQL_LATE_ROWS),
    "detailed_counters": (detailed_counters, SQL_DETAILED),
    "stream_state_rows": (stream_state_rows, SQL_STATES),
}
