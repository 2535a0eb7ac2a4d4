"""Registered queries about the state inside a game."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contest
from ..functions.numbers import sigmoid
from ..operators import live, scores
from ..sources import standin
from .catalog_scores import RIGHT, rnd
from .views_sql import with_views


def _state(spark, folder):
    return live.running_state(live.GameEvents(standin.plays(spark, folder)))


def _long(df, names):
    return df.select("game_id", "event_id", *[F.col(n).cast("long").alias(n) for n in names])


SIT = """sit AS (SELECT *, CAST(substr(situation_code, 1, 1) AS BIGINT) AS ag, CAST(substr(situation_code, 2, 1) AS BIGINT) AS ask,
  CAST(substr(situation_code, 3, 1) AS BIGINT) AS hsk, CAST(substr(situation_code, 4, 1) AS BIGINT) AS hg FROM plays_v),
pp AS (SELECT *, CASE WHEN hsk > ask THEN 'home' WHEN ask > hsk THEN 'away' END AS edge FROM sit)"""
W = "OVER (PARTITION BY game_id ORDER BY sort_order, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _cum(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) {W} AS BIGINT)"


def _counter_sql(names) -> str:
    out = []
    for own, other in (("home", "away"), ("away", "home")):
        mine, theirs = f"side = '{own}'", f"side = '{other}'"
        made = {
            "sog": _cum(f"event_type IN ('shot-on-goal','goal') AND {mine}"),
            "shot_attempts": _cum(f"event_type IN ('shot-on-goal','missed-shot','blocked-shot','goal') AND {mine}"),
            "missed_shots": _cum(f"event_type = 'missed-shot' AND {mine}"),
            "faceoff_wins": _cum(f"event_type = 'faceoff' AND {mine}"),
            "penalties": _cum(f"event_type = 'penalty' AND {mine}"),
            "penalty_minutes": f"CAST(SUM(CASE WHEN event_type = 'penalty' AND {mine} THEN penalty_minutes ELSE 0 END) {W} AS BIGINT)",
            "goalie_saves": _cum(f"event_type = 'shot-on-goal' AND {theirs}"),
            "goalie_goals_against": _cum(f"event_type = 'goal' AND {theirs}"),
            "score": _cum(f"event_type = 'goal' AND {mine}"),
        }
        out += [f"{made[n]} AS {own}_{n}" for n in names]
    return ", ".join(out)


COUNTED = ("sog", "shot_attempts", "missed_shots", "faceoff_wins", "penalties", "penalty_minutes", "goalie_saves", "goalie_goals_against")


def play_counters(spark, folder):
    names = [f"{s}_{n}" for s in ("home", "away") for n in COUNTED]
    return _long(_state(spark, folder), ["event_index", *names])


SQL_COUNTERS = with_views(
    "plays_v",
    f"SELECT game_id, event_id, row_number() OVER (PARTITION BY game_id ORDER BY sort_order, event_id) AS event_index, {_counter_sql(COUNTED)} FROM plays_v",
)


def running_score(spark, folder):
    state = _state(spark, folder)
    return state.select(
        "game_id", "event_id", "home_score", "away_score", F.col("score_diff_home").cast("long").alias("score_diff_home"),
        F.col("abs_score_diff").cast("long").alias("abs_score_diff"), "home_goalie_save_pct_live", "away_goalie_save_pct_live",
    )


def _save(s: str) -> str:
    return rnd(f"CAST({s}_goalie_saves AS DOUBLE) / nullif({s}_goalie_saves + {s}_goalie_goals_against, 0)", 4)


SQL_SCORE = with_views(
    "plays_v",
    f"""st AS (SELECT game_id, event_id, {_counter_sql(("score", "goalie_saves", "goalie_goals_against"))} FROM plays_v)
SELECT game_id, event_id, home_score, away_score, home_score - away_score AS score_diff_home, abs(home_score - away_score) AS abs_score_diff,
 {_save('home')} AS home_goalie_save_pct_live, {_save('away')} AS away_goalie_save_pct_live FROM st""",
)

PP = ("power_play_opportunities", "power_play_goals", "short_handed_goals")


def power_play_opps(spark, folder):
    return _long(_state(spark, folder), [f"{s}_{n}" for s in ("home", "away") for n in PP])


def _pp_sql() -> str:
    out = []
    for own, other, hi, lo in (("home", "away", "hsk", "ask"), ("away", "home", "ask", "hsk")):
        out += [
            f"{_cum(f'''edge = '{own}' AND edge IS DISTINCT FROM before''')} AS {own}_power_play_opportunities",
            f"{_cum(f'''event_type = 'goal' AND side = '{own}' AND {hi} > {lo}''')} AS {own}_power_play_goals",
            f"{_cum(f'''event_type = 'goal' AND side = '{own}' AND {hi} < {lo}''')} AS {own}_short_handed_goals",
        ]
    return ", ".join(out)


SQL_PP = with_views(
    "plays_v",
    f"{SIT}, lagged AS (SELECT *, lag(edge) OVER (PARTITION BY game_id ORDER BY sort_order, event_id) AS before FROM pp) SELECT game_id, event_id, {_pp_sql()} FROM lagged",
)

FLAGS = ("home_skaters", "away_skaters", "home_goalie_on_ice", "away_goalie_on_ice", "home_empty_net", "away_empty_net",
         "manpower_diff_home", "home_power_play", "away_power_play", "even_strength")


def situation_parse(spark, folder):
    return _long(live.with_situation(standin.play_events(spark, folder)), list(FLAGS))


SQL_SIT = with_views(
    "plays_v",
    f"""{SIT} SELECT game_id, event_id, hsk AS home_skaters, ask AS away_skaters, hg AS home_goalie_on_ice, ag AS away_goalie_on_ice,
 CAST(hg = 0 AS BIGINT) AS home_empty_net, CAST(ag = 0 AS BIGINT) AS away_empty_net, hsk - ask AS manpower_diff_home,
 CAST(hsk > ask AS BIGINT) AS home_power_play, CAST(ask > hsk AS BIGINT) AS away_power_play, CAST(hsk = ask AS BIGINT) AS even_strength FROM sit""",
)


def active_penalties(spark, folder):
    return live.active_penalties(live.GameEvents(standin.plays(spark, folder)))


SQL_PENALTIES = with_views(
    "plays_v",
    f"""{SIT}, ev AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY sort_order, event_id) AS i FROM pp),
step AS (
 SELECT game_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS now, CAST([] AS STRUCT(s VARCHAR, e BIGINT, m BOOLEAN)[]) AS act
 FROM (SELECT DISTINCT game_id FROM ev) g
 UNION ALL
 SELECT game_id, i, now, CASE
   WHEN event_type = 'goal' AND edge = side AND pos IS NOT NULL THEN list_filter(act, lambda p, j: j <> pos)
   WHEN event_type = 'penalty' AND penalty_minutes > 0 THEN list_append(act, {{'s': side, 'e': now + penalty_minutes * 60, 'm': penalty_minutes <= 2}})
   ELSE act END
 FROM (SELECT *, list_position(list_transform(act, lambda p: p.m AND p.s <> side), true) AS pos
  FROM (SELECT n.game_id, n.i, n.seconds_elapsed AS now, n.event_type, n.side, n.edge, n.penalty_minutes,
    list_filter(s.act, lambda p: p.e > n.seconds_elapsed) AS act
   FROM step s JOIN ev n ON n.game_id = s.game_id AND n.i = s.i + 1) a) b)
SELECT game_id, i AS event_index,
 CAST(len(list_filter(act, lambda p: p.s = 'home')) AS BIGINT) AS home_active_penalties, CAST(len(list_filter(act, lambda p: p.s = 'away')) AS BIGINT) AS away_active_penalties,
 CAST(COALESCE(list_sum(list_transform(list_filter(act, lambda p: p.s = 'home'), lambda p: greatest(0, p.e - now))), 0) AS BIGINT) AS home_active_penalty_seconds,
 CAST(COALESCE(list_sum(list_transform(list_filter(act, lambda p: p.s = 'away'), lambda p: greatest(0, p.e - now))), 0) AS BIGINT) AS away_active_penalty_seconds
FROM step WHERE i > 0""",
    recursive=True,
)


LATEST = ("home_score", "away_score", "home_sog", "away_sog", "home_penalty_minutes", "away_penalty_minutes")


def latest_state_per_game(spark, folder):
    made = live.latest_state(_state(spark, folder), ["event_id", *LATEST])
    return made.select("game_id", "event_id", *[F.col(c).cast("long").alias(c) for c in ("event_index", *LATEST)])


def _final(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


SQL_LATEST = with_views(
    "plays_v",
    f"""SELECT game_id, arg_max(event_id, sort_order) AS event_id, COUNT(*) AS event_index,
 {_final("event_type='goal' AND side='home'")} AS home_score, {_final("event_type='goal' AND side='away'")} AS away_score,
 {_final("event_type IN ('goal','shot-on-goal') AND side='home'")} AS home_sog, {_final("event_type IN ('goal','shot-on-goal') AND side='away'")} AS away_sog,
 CAST(COALESCE(SUM(penalty_minutes) FILTER (WHERE side='home'), 0) AS BIGINT) AS home_penalty_minutes,
 CAST(COALESCE(SUM(penalty_minutes) FILTER (WHERE side='away'), 0) AS BIGINT) AS away_penalty_minutes FROM plays_v GROUP BY game_id""",
)


def _probability():
    """A plain stand-in for a live model: the scaled score difference through a sigmoid."""
    left = F.greatest(F.lit(0), 3600 - F.least(F.col("seconds_elapsed"), F.lit(3600)))
    return sigmoid(contest.score_per_root_time(F.col("score_diff_home"), left) * 20)


def event_timeline(spark, folder):
    events = live.GameEvents(standin.plays(spark, folder))
    kept = live.thin(live.running_state(events))
    rows = live.timeline(kept, _probability())
    period = F.floor(F.col("seconds_elapsed") / 1200) + 1
    return rows.select(
        "game_id",
        F.col("event_index").cast("long").alias("event_index"),
        (F.rint(F.col("seconds_elapsed") / 60 * 10) / 10).alias("minute"),
        contest.event_label(F.col("event_type"), F.upper("side"), period).alias("label"),
        F.coalesce("side", F.lit("neutral")).alias("team"),
        "home_prob",
        "change",
        "home_score",
        "away_score",
    )


SQL_TIMELINE = with_views(
    "plays_v",
    f"""st AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY sort_order, event_id) AS event_index, COUNT(*) OVER (PARTITION BY game_id) AS size,
   {_counter_sql(("score",))} FROM plays_v),
kept AS (SELECT *, {rnd("100 * (1 / (1 + exp(-((home_score - away_score) / sqrt(greatest(0, 3600 - least(seconds_elapsed, 3600)) + 1.0::DOUBLE) * 20))))", 1)} AS home_prob
  FROM st WHERE event_type IN ('goal', 'penalty', 'period-start', 'period-end') OR event_index % greatest(1, size // 30) = 0)
SELECT game_id, event_index, {rnd("seconds_elapsed / 60.0::DOUBLE", 1)} AS minute,
 CASE event_type WHEN 'goal' THEN upper(side) || ' goal' WHEN 'penalty' THEN upper(side) || ' penalty' WHEN 'faceoff' THEN 'Faceoff'
   WHEN 'shot-on-goal' THEN upper(side) || ' shot on goal' ELSE upper(side) || ' shot misses' END AS label, side AS team, home_prob,
 {rnd("home_prob - lag(home_prob) OVER (PARTITION BY game_id ORDER BY event_index)", 1)} AS change, home_score, away_score FROM kept""",
)


def pbp_event_rollup(spark, folder):
    """Distinct games, events and the truncated median of events per game."""
    sizes = standin.play_events(spark, folder).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("games"), F.sum("n").alias("events"), F.floor(F.median("n")).cast("long").alias("events_per_game")
    )


SQL_ROLLUP = with_views(
    "plays_v",
    "SELECT COUNT(*) AS games, CAST(SUM(n) AS BIGINT) AS events, CAST(floor(median(n)) AS BIGINT) AS events_per_game FROM (SELECT game_id, COUNT(*) AS n FROM plays_v GROUP BY game_id) t",
)


def _scored(spark, folder):
    """Events with a live probability, the prior of their game (.54 where none) and the outcome."""
    state = _state(spark, folder)
    preds = standin.predictions(spark, folder).select("game_id", "p_home", "y", "game_state")
    joined = state.join(preds, "game_id", "left")
    return joined.select(
        "game_id", "event_id", _probability().alias("p"), F.coalesce("p_home", F.lit(contest.NEUTRAL_PRIOR)).alias("prior"),
        F.when(contest.is_completed(F.col("game_state")), F.col("y")).alias("y"), (F.col("seconds_elapsed") / 3960.0).alias("game_progress"),
    )


def phase_buckets(spark, folder):
    return scores.phase_buckets(_scored(spark, folder).filter(F.col("y").isNotNull()))


_SCORED = f"""st AS (SELECT *, {_counter_sql(("score",))} FROM plays_v),
scored AS (SELECT st.game_id, st.event_id, 1 / (1 + exp(-((st.home_score - st.away_score) / sqrt(greatest(0, 3600 - least(seconds_elapsed, 3600)) + 1.0::DOUBLE) * 20))) AS p,
  COALESCE(p_home, 0.54::DOUBLE) AS prior, CASE WHEN game_state = 'OFF' THEN y END AS y, seconds_elapsed / 3960.0::DOUBLE AS game_progress FROM st LEFT JOIN preds_v USING (game_id))"""
_LL = "-CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) ELSE ln(1 - greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) END"
_PHASE = "CASE " + " ".join(
    f"WHEN x > {a} AND x <= {b} THEN '({a}, {b}]'" for a, b in zip(scores.PHASES[:-1], scores.PHASES[1:], strict=True)
) + " END"
SQL_PHASE = with_views(
    "preds_v plays_v",
    f"""{_SCORED}, ph AS (SELECT *, {_PHASE} AS phase FROM (SELECT *, least(greatest(game_progress, 0.0::DOUBLE), 1.0::DOUBLE) AS x FROM scored) t),
rk AS (SELECT *, rank() OVER (PARTITION BY phase ORDER BY p) + (COUNT(*) OVER (PARTITION BY phase, p) - 1) / 2.0::DOUBLE AS r FROM ph WHERE phase IS NOT NULL AND y IS NOT NULL)
SELECT phase, COUNT(*) AS n, {rnd(f'avg({RIGHT})', 4)} AS accuracy, {rnd(f'avg({_LL})', 4)} AS log_loss,
 {rnd('(SUM(CASE WHEN y = 1 THEN r END) - SUM(y) * (SUM(y) + 1) / 2.0::DOUBLE) / nullif(SUM(y) * (COUNT(*) - SUM(y)), 0)', 6)} AS auc FROM rk GROUP BY phase""",
)


def prior_attach(spark, folder):
    """Prior of each event's game, neutral where the game was never predicted, and its correlation at the start."""
    scored = _scored(spark, folder)
    return scored.groupBy("game_id").agg(F.max("prior").alias("prior"), F.count(F.lit(1)).alias("events"))


SQL_PRIOR = with_views("preds_v plays_v", _SCORED + " SELECT game_id, MAX(prior) AS prior, COUNT(*) AS events FROM scored GROUP BY game_id")


# share of a game that counts as its start
START = 0.01


def puck_drop_correlation(spark, folder):
    """Correlation of a live probability with its prior on the first events of the games."""
    rows = _scored(spark, folder).filter(F.col("game_progress") < START)
    return rows.agg(F.count(F.lit(1)).alias("events"), (F.rint(F.corr("p", "prior") * 1e6) / 1e6).alias("correlation"))


SQL_CORR = with_views(
    "preds_v plays_v",
    _SCORED + f" SELECT COUNT(*) AS events, {rnd('corr(p, prior)', 6)} AS correlation FROM scored WHERE game_progress < {START}",
)

QUERIES = {
    "play_counters": (play_counters, SQL_COUNTERS),
    "running_score": (running_score, SQL_SCORE),
    "power_play_opps": (power_play_opps, SQL_PP),
    "situation_parse": (situation_parse, SQL_SIT),
    "active_penalties": (active_penalties, SQL_PENALTIES),
    "latest_state_per_game": (latest_state_per_game, SQL_LATEST),
    "event_timeline": (event_timeline, SQL_TIMELINE),
    "pbp_event_rollup": (pbp_event_rollup, SQL_ROLLUP),
    "phase_buckets": (phase_buckets, SQL_PHASE),
    "prior_attach": (prior_attach, SQL_PRIOR),
    "puck_drop_correlation": (puck_drop_correlation, SQL_CORR),
}
