"""Registered queries about form, pairings and merged features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import clock_seconds
from ..operators import boxes, history, matchups
from ..session import materialise
from ..sources import standin
from .views_sql import with_views


def _names(df, drop=()):
    return [c for c in df.columns if c not in drop]


def _out(df, columns):
    """Select columns with dates as text, so both engines print them alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in ("game_date", "source_date") else F.col(c) for c in columns])


# Shared SQL: team games, one row per side, numbered per team; `c` counts the games on strictly earlier dates.
HIST = """
done AS (SELECT * FROM games_v WHERE game_state IN ('OFF', 'FINAL') AND game_type IN {types}),
sides AS (
 SELECT game_id, season, game_type, game_date, home_team AS team, away_team AS opponent, CAST(1 AS BIGINT) AS is_home,
        CAST(home_score AS DOUBLE) AS goals_for, CAST(away_score AS DOUBLE) AS goals_against, last_period_type FROM done
 UNION ALL
 SELECT game_id, season, game_type, game_date, away_team, home_team, CAST(0 AS BIGINT),
        CAST(away_score AS DOUBLE), CAST(home_score AS DOUBLE), last_period_type FROM done),
hist AS (
 SELECT *, CASE WHEN goals_for > goals_against THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS win,
        row_number() OVER (PARTITION BY team ORDER BY game_date, game_id) AS rn,
        count(*) OVER (PARTITION BY team ORDER BY game_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS c
 FROM sides)"""

R4 = "round_even(({0}) * 10000.0::DOUBLE, 0) / 10000.0::DOUBLE"


def r4(expression: str) -> str:
    return R4.format(expression)


def last_mean(metric: str, n: int) -> str:
    """Mean of the last n earlier games, folded in game order."""
    listed = f"list(h.{metric} ORDER BY h.rn) FILTER (WHERE h.{metric} IS NOT NULL AND h.rn > g.c - {n})"
    return r4(f"list_sum({listed}) / len({listed})") if False else r4(
        f"list_reduce({listed}, lambda a, b: a + b) / len({listed})"
    )


# ---- flagship: last-5 and last-10 form ------------------------------------------------------------------------

FORM = ("last_5_win_pct", "last_10_win_pct", "last_5_goals_for_avg", "last_5_goals_against_avg", "goal_diff_last_10")


def flag_rolling_form(spark, folder):
    made = history.score_features(standin.games(spark, folder))
    return _out(made, ["game_id", "game_date", *[f"{s}_{c}" for s in ("home", "away") for c in FORM]])


def _form_sql(sides: str, names: dict[str, str]) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in names.items())
    return f"""
form AS (
 SELECT g.game_id, g.is_home, {cols}
 FROM hist g LEFT JOIN hist h ON h.team = g.team AND h.rn <= g.c AND h.rn > g.c - 10
 GROUP BY g.game_id, g.is_home, g.c)"""


FLAG_EXPRS = {
    "last_5_win_pct": last_mean("win", 5),
    "last_10_win_pct": last_mean("win", 10),
    "last_5_goals_for_avg": last_mean("goals_for", 5),
    "last_5_goals_against_avg": last_mean("goals_against", 5),
    "goal_diff_last_10": "SUM(h.goals_for - h.goals_against)",
}


def _two_sides(names) -> str:
    return ", ".join(f"{a}.{n} AS {s}_{n}" for s, a in (("home", "fh"), ("away", "fa")) for n in names)


SQL_FLAG = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + "," + _form_sql("hist", FLAG_EXPRS) + f"""
SELECT d.game_id, CAST(d.game_date AS VARCHAR) AS game_date, {_two_sides(FORM)}
FROM done d JOIN form fh ON fh.game_id = d.game_id AND fh.is_home = 1
            JOIN form fa ON fa.game_id = d.game_id AND fa.is_home = 0""",
)

# ---- rest and congestion ------------------------------------------------------------------------------------

REST = ("rest_days", "games_last_3_days", "games_last_7_days", "games_last_14_days", "back_to_back")


def _days(spark, folder):
    done = history.eligible(standin.games(spark, folder))
    return done, history.team_days(history.team_games(done), None, ())


def rest_and_congestion(spark, folder):
    done, days = _days(spark, folder)
    made = history.schedule_columns() | {"rest_days_capped": history.schedule_columns(14)["rest_days"]}
    rows = days.rows.selectExpr("team", "season", "game_date", *[f"{e} AS {c}" for c, e in made.items()])
    made_games = history.attach(done, rows)
    return _out(made_games, ["game_id", "game_date", *[f"{s}_{c}" for s in ("home", "away") for c in (*REST, "rest_days_capped")]])


def _count_days(n: int) -> str:
    return (
        "CAST(count(*) OVER (PARTITION BY team ORDER BY game_date RANGE BETWEEN INTERVAL "
        f"{n} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS DOUBLE)"
    )


SQL_REST = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + f""",
gap AS (SELECT *, CAST(date_diff('day', max(game_date) OVER (PARTITION BY team ORDER BY game_date
          RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), game_date) AS DOUBLE) AS rest_days FROM hist),
form AS (
 SELECT game_id, is_home, rest_days, {_count_days(3)} AS games_last_3_days, {_count_days(7)} AS games_last_7_days,
        {_count_days(14)} AS games_last_14_days, CASE WHEN rest_days = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS back_to_back,
        CASE WHEN rest_days > 14 THEN 14.0::DOUBLE ELSE rest_days END AS rest_days_capped FROM gap)
SELECT d.game_id, CAST(d.game_date AS VARCHAR) AS game_date, {_two_sides((*REST, "rest_days_capped"))}
FROM done d JOIN form fh ON fh.game_id = d.game_id AND fh.is_home = 1
            JOIN form fa ON fa.game_id = d.game_id AND fa.is_home = 0""",
)

# ---- season splits --------------------------------------------------------------------------------------------

SPLITS = (
    "season_points_pct_before_game", "home_win_pct_before_game", "road_win_pct_before_game",
    "home_goal_diff_avg_before_game", "road_goal_diff_avg_before_game",
)


def season_splits(spark, folder):
    done, days = _days(spark, folder)
    rows = days.rows.selectExpr("team", "season", "game_date", *[f"{e} AS {c}" for c, e in history.split_columns().items()])
    return _out(history.attach(done, rows), ["game_id", "game_date", *[f"{s}_{c}" for s in ("home", "away") for c in SPLITS]])


def _split_exprs() -> dict[str, str]:
    w = "OVER (PARTITION BY team, season ORDER BY game_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    over = lambda e: f"({e} {w})"
    out = {"season_points_pct_before_game": r4(over("SUM(2 * win)") + " / nullif(2 * " + over("count(*)") + ", 0)")}
    for name, flag in (("home", 1), ("road", 0)):
        n = "nullif(" + over(f"count(*) FILTER (WHERE is_home = {flag})") + ", 0)"
        out[f"{name}_win_pct_before_game"] = r4(over(f"SUM(win) FILTER (WHERE is_home = {flag})") + f" / {n}")
        out[f"{name}_goal_diff_avg_before_game"] = r4(
            over(f"SUM(goals_for - goals_against) FILTER (WHERE is_home = {flag})") + f" / {n}"
        )
    return out


SQL_SPLITS = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + ", form AS (SELECT game_id, is_home, "
    + ", ".join(f"{e} AS {n}" for n, e in _split_exprs().items()) + f""" FROM hist)
SELECT d.game_id, CAST(d.game_date AS VARCHAR) AS game_date, {_two_sides(SPLITS)}
FROM done d JOIN form fh ON fh.game_id = d.game_id AND fh.is_home = 1
            JOIN form fa ON fa.game_id = d.game_id AND fa.is_home = 0""",
)

# ---- head to head, series ---------------------------------------------------------------------------------------

H2H = ("h2h_games_last_365_days", "h2h_home_team_win_pct_last_5", "h2h_home_team_goal_diff_avg_last_5")


def head_to_head(spark, folder):
    done = history.eligible(standin.games(spark, folder))
    return _out(matchups.head_to_head(done, done), ["game_id", "game_date", *H2H])


_H2H_CTE = """
pairs AS (
 SELECT *, least(home_team, away_team) AS lo, greatest(home_team, away_team) AS hi,
        row_number() OVER (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY game_date, game_id) AS prn,
        count(*) OVER (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY game_date
                       RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS pc,
        CAST(count(*) OVER (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY game_date
                       RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS DOUBLE) AS h2h_games_last_365_days
 FROM done),
h2h AS (
 SELECT g.game_id, g.h2h_games_last_365_days,
        {win} AS h2h_home_team_win_pct_last_5, {diff} AS h2h_home_team_goal_diff_avg_last_5
 FROM pairs g LEFT JOIN pairs h ON h.lo = g.lo AND h.hi = g.hi AND h.prn <= g.pc AND h.prn > g.pc - 5
 GROUP BY g.game_id, g.h2h_games_last_365_days)""".format(
    win=r4(
        "CAST(SUM(CASE WHEN (h.home_team = g.home_team) = (h.home_score > h.away_score) THEN 1 ELSE 0 END)"
        " FILTER (WHERE h.game_id IS NOT NULL) AS DOUBLE) / nullif(count(h.game_id), 0)"
    ),
    diff=r4(
        "CAST(SUM(CASE WHEN h.home_team = g.home_team THEN h.home_score - h.away_score ELSE h.away_score - h.home_score END)"
        " AS DOUBLE) / nullif(count(h.game_id), 0)"
    ),
)

SQL_H2H = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + "," + _H2H_CTE + f"""
SELECT d.game_id, CAST(d.game_date AS VARCHAR) AS game_date, {", ".join(H2H)} FROM done d JOIN h2h USING (game_id)""",
)


def series_state(spark, folder):
    done = history.eligible(standin.games(spark, folder))
    return _out(matchups.series_state(done), ["game_id", "game_date", *matchups.SERIES_COLUMNS])


_SERIES_CTE = """
ser AS (
 SELECT *, row_number() OVER w AS no,
   COALESCE(SUM(CASE WHEN (home_team < away_team) = (home_score > away_score) THEN 1 ELSE 0 END)
      OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low_wins
 FROM done WHERE game_type = 3
 WINDOW w AS (PARTITION BY season, CASE WHEN length(CAST(game_id AS VARCHAR)) >= 10 THEN substr(CAST(game_id AS VARCHAR), 7, 3)
    ELSE least(CAST(home_team AS VARCHAR), CAST(away_team AS VARCHAR)) || '-' || greatest(CAST(home_team AS VARCHAR), CAST(away_team AS VARCHAR)) END
    ORDER BY game_date, game_id)),
ser2 AS (SELECT *, CASE WHEN home_team < away_team THEN low_wins ELSE no - 1 - low_wins END AS hw,
                CASE WHEN home_team < away_team THEN no - 1 - low_wins ELSE low_wins END AS aw FROM ser)"""
_SERIES_COLS = """CAST(COALESCE(s.no, 0) AS BIGINT) AS playoff_series_game_number, CAST(COALESCE(hw, 0) AS BIGINT) AS home_series_wins_before,
       CAST(COALESCE(aw, 0) AS BIGINT) AS away_series_wins_before, CAST(COALESCE(hw - aw, 0) AS BIGINT) AS series_win_diff_before,
       CAST(CASE WHEN aw = 3 THEN 1 ELSE 0 END AS BIGINT) AS home_elimination_game,
       CAST(CASE WHEN hw = 3 THEN 1 ELSE 0 END AS BIGINT) AS away_elimination_game"""

SQL_SERIES = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + "," + _SERIES_CTE + f"""
SELECT d.game_id, CAST(d.game_date AS VARCHAR) AS game_date, {_SERIES_COLS}
FROM done d LEFT JOIN ser2 s ON s.game_id = d.game_id""",
)

# ---- box aggregates ---------------------------------------------------------------------------------------------


def skater_team_agg(spark, folder):
    made = boxes.skater_totals(standin.skater_lines(spark, folder), ["game_id", "is_home"])
    return made.withColumn("skaters_avg_toi_seconds", F.rint(F.col("skaters_avg_toi_seconds") * 1e4) / 1e4)


SQL_SKATERS = with_views(
    "skaters_v",
    f"""SELECT game_id, is_home, count(player_id) AS skater_count, CAST(SUM(goals) AS BIGINT) AS skaters_goals,
 CAST(SUM(assists) AS BIGINT) AS skaters_assists, CAST(SUM(points) AS BIGINT) AS skaters_points, CAST(SUM(shots) AS BIGINT) AS skaters_shots,
 CAST(SUM(hits) AS BIGINT) AS skaters_hits, CAST(SUM(blocked_shots) AS BIGINT) AS skaters_blocked_shots,
 {r4("CAST(SUM(toi_seconds) AS DOUBLE) / COUNT(*)")} AS skaters_avg_toi_seconds
 FROM skaters_v GROUP BY game_id, is_home""",
)


def starter_argmax(spark, folder):
    return boxes.starters(standin.goalie_lines(spark, folder), ["game_id", "is_home"], "line_order")


_STARTER = """
start_v AS (
 SELECT game_id, is_home, player_id AS starting_goalie_id, goalie_name AS starting_goalie_name, save_pct AS starting_goalie_save_pct,
        CAST(goals_against AS DOUBLE) AS starting_goalie_goals_against, CAST(shots_against AS DOUBLE) AS starting_goalie_shots_against,
        CASE WHEN save_pct >= 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS starting_goalie_quality_start
 FROM (SELECT *, row_number() OVER (PARTITION BY game_id, is_home ORDER BY toi_seconds DESC, line_order, player_id) AS r FROM goalies_v) t
 WHERE r = 1)"""

SQL_STARTER = with_views("goalies_v", _STARTER + " SELECT * FROM start_v")


def es_attempt_share(spark, folder):
    return boxes.side_counts(standin.play_events(spark, folder), ["game_id", "side"])


SQL_ES = with_views(
    "plays_v",
    """SELECT game_id, side,
 CAST(SUM(CASE WHEN event_type IN ('shot-on-goal','missed-shot','goal') THEN 1 ELSE 0 END) AS BIGINT) AS shot_attempts,
 CAST(SUM(CASE WHEN event_type IN ('shot-on-goal','goal') THEN 1 ELSE 0 END) AS BIGINT) AS shots_on_goal,
 CAST(SUM(CASE WHEN event_type = 'goal' THEN 1 ELSE 0 END) AS BIGINT) AS goals,
 CAST(SUM(CASE WHEN event_type IN ('shot-on-goal','missed-shot','goal') AND situation_code = '1551' THEN 1 ELSE 0 END) AS BIGINT) AS es_shot_attempts,
 CAST(SUM(CASE WHEN event_type IN ('shot-on-goal','goal') AND situation_code = '1551' THEN 1 ELSE 0 END) AS BIGINT) AS es_shots_on_goal,
 CAST(SUM(CASE WHEN event_type = 'goal' AND situation_code = '1551' THEN 1 ELSE 0 END) AS BIGINT) AS es_goals
 FROM plays_v GROUP BY game_id, side""",
)

# ---- the 25 regular-season columns and the full merged row ----------------------------------------------------

BASIC = (
    "rest_days", "back_to_back", "last_5_win_pct", "last_10_win_pct", "last_5_goals_for_avg", "last_5_goals_against_avg",
    "last_10_shots_for_avg", "last_10_shots_against_avg", "season_points_pct_before_game", "goal_diff_last_10",
)


def model_features_25(spark, folder):
    done = history.eligible(standin.games(spark, folder), (2,))
    lines = boxes.with_opponent(standin.box_scores(spark, folder), {"shots_for": "shots_against"})
    lines = lines.select("game_id", "is_home", F.col("shots_for").cast("double"), F.col("shots_against").cast("double"))
    sides = history.team_games(done)
    rows = sides.join(lines, ["game_id", "is_home"], "left")
    days = history.team_days(rows, None, (*history.SCORE_METRICS, "shots_for", "shots_against"), totals=sides)
    made = history.attach(done, history.features(days))
    return made.select(
        "game_id",
        F.col("game_date").cast("string").alias("date"),
        "home_team",
        "away_team",
        (F.col("home_score") > F.col("away_score")).cast("long").alias("home_win"),
        *[f"{s}_{c}" for c in BASIC for s in ("home", "away")],
    )


def completed_games(spark, folder):
    """The completed games, written once: every group of features reads them."""
    return materialise(history.eligible(standin.games(spark, folder)), "completed-games")


def full_form(spark, folder, done):
    """All form features of the team-days of completed games."""
    sides = history.team_games(done)
    # form looks at ten games of a day at most: only those are joined with box scores, plays and players
    recent = materialise(history.latest_rows_of_day(sides, ["team", "game_date"]), "recent-sides")
    ids = recent.select("game_id").distinct()
    lines = materialise(standin.line_items(spark, folder, ids), "recent-lines")
    box, goalies, skaters = (t(spark, folder, lines) for t in (standin.box_scores, standin.goalie_lines, standin.skater_lines))
    rows = boxes.full_history(recent, box, standin.play_events(spark, folder).join(ids, "game_id", "left_semi"), goalies, skaters)
    metrics = tuple(dict.fromkeys((*history.LAST_5, *history.LAST_10, *history.LAST_3, "starting_goalie_id", "starting_goalie_name")))
    return history.features(history.team_days(rows, None, metrics, totals=sides))


def paired(done):
    """Completed games with their head-to-head and series columns."""
    return matchups.head_to_head(done, matchups.series_state(done), keys_of=done)


def with_form(rows, form):
    """Both sides' form and the differences beside rows of games."""
    return history.with_differences(history.attach(rows, form))


def merged_columns():
    """The columns of the merged features."""
    names = [f"{s}_{c}" for s in ("home", "away") for c in history.TEAM_FEATURES]
    return [
        "game_id", "season", "game_type", F.col("game_date").cast("string").alias("game_date"), "home_team", "away_team",
        "home_score", "away_score",
        F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).otherwise(F.col("away_team")).alias("winner_team"),
        (F.col("home_score") > F.col("away_score")).cast("long").alias("target_home_win"),
        *names, *history.diff_pairs(), *H2H, *matchups.SERIES_COLUMNS,
    ]


def merged_features(spark, folder):
    """Every feature of a completed game: both sides, differences, head to head, series."""
    done = completed_games(spark, folder)
    made = with_form(paired(done), full_form(spark, folder, done))
    return made.select(*merged_columns())


_FULL_HIST = """
es AS (SELECT game_id, CAST(side = 'home' AS BIGINT) AS is_home,
  CAST(SUM(CASE WHEN event_type IN ('shot-on-goal','missed-shot','goal') AND situation_code = '1551' THEN 1 ELSE 0 END) AS DOUBLE) AS att,
  CAST(SUM(CASE WHEN event_type = 'goal' AND situation_code = '1551' THEN 1 ELSE 0 END) AS DOUBLE) AS gl
  FROM plays_v GROUP BY game_id, side),
sk AS (SELECT game_id, is_home, CAST(SUM(points) AS DOUBLE) AS skaters_points, CAST(SUM(shots) AS DOUBLE) AS skaters_shots,
  CAST(SUM(toi_seconds) AS DOUBLE) / COUNT(*) AS skaters_avg_toi_seconds FROM skaters_v GROUP BY 1, 2),
hist AS (
 SELECT b.*, CAST(x.shots_for AS DOUBLE) AS shots_for, CAST(o.shots_for AS DOUBLE) AS shots_against,
   CASE WHEN o.game_id IS NULL THEN NULL END AS nothing,
   CAST(x.powerplay_goals AS DOUBLE) AS powerplay_goals, CAST(x.penalty_minutes AS DOUBLE) AS penalty_minutes, x.faceoff_win_pct,
   CAST(x.blocked_shots AS DOUBLE) AS blocked_shots, CAST(x.hits AS DOUBLE) AS hits, CAST(x.giveaways AS DOUBLE) AS giveaways,
   CAST(x.takeaways AS DOUBLE) AS takeaways, e.att AS es_shot_attempts_for, f.att AS es_shot_attempts_against,
   e.gl AS es_goals_for, f.gl AS es_goals_against, sk.skaters_points, sk.skaters_shots, sk.skaters_avg_toi_seconds,
   st.starting_goalie_id, st.starting_goalie_name, st.starting_goalie_save_pct, st.starting_goalie_goals_against,
   st.starting_goalie_shots_against, st.starting_goalie_quality_start
 FROM base_hist b
 LEFT JOIN box_v x ON x.game_id = b.game_id AND x.is_home = b.is_home
 LEFT JOIN box_v o ON o.game_id = b.game_id AND o.is_home = 1 - b.is_home AND x.game_id IS NOT NULL
 LEFT JOIN es e ON e.game_id = b.game_id AND e.is_home = b.is_home
 LEFT JOIN es f ON f.game_id = b.game_id AND f.is_home = 1 - b.is_home
 LEFT JOIN sk ON sk.game_id = b.game_id AND sk.is_home = b.is_home
 LEFT JOIN start_v st ON st.game_id = b.game_id AND st.is_home = b.is_home)"""


def _full_exprs() -> dict[str, str]:
    out = {f"last_5_{m}_{'pct' if m == 'win' else 'avg'}": last_mean(m, 5) for m in history.LAST_5}
    for m in history.LAST_10:
        name = {"win": "last_10_win_pct", "skaters_avg_toi_seconds": "last_10_skaters_avg_toi_seconds"}.get(m, f"last_10_{m}_avg")
        out[name] = last_mean(m, 10)
    out["goal_diff_last_10"] = "SUM(h.goals_for - h.goals_against)"
    out["last_10_es_shot_attempt_share"] = r4(
        "SUM(h.es_shot_attempts_for) / nullif(COALESCE(SUM(h.es_shot_attempts_for), 0) + COALESCE(SUM(h.es_shot_attempts_against), 0), 0)"
    ).replace("SUM(h.es_shot_attempts_for) /", "COALESCE(SUM(h.es_shot_attempts_for), 0.0::DOUBLE) /")
    out["last_starting_goalie_id"] = "MAX(h.starting_goalie_id) FILTER (WHERE h.rn = g.c)"
    out["last_starting_goalie_name"] = "MAX(h.starting_goalie_name) FILTER (WHERE h.rn = g.c)"
    for m in history.LAST_3:
        ending = {"starting_goalie_save_pct": "", "starting_goalie_quality_start": "_pct"}.get(m, "_avg")
        out[f"last_3_{m}{ending}"] = last_mean(m, 3)
    return out


def _sched_cte() -> str:
    return f"""
gap AS (SELECT *, CAST(date_diff('day', max(game_date) OVER (PARTITION BY team ORDER BY game_date
          RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), game_date) AS DOUBLE) AS rest_days FROM hist),
sched AS (
 SELECT game_id, is_home, rest_days, {_count_days(3)} AS games_last_3_days, {_count_days(7)} AS games_last_7_days,
        {_count_days(14)} AS games_last_14_days, CASE WHEN rest_days = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS back_to_back,
        {", ".join(f"{e} AS {n}" for n, e in _split_exprs().items())} FROM gap)"""


_BASIC_HIST = HIST.format(types="(2)").replace("hist AS (", "base_hist AS (").replace("IN (2)", "IN (2)") + """,
hist AS (SELECT b.*, CAST(x.shots_for AS DOUBLE) AS shots_for, CAST(o.shots_for AS DOUBLE) AS shots_against
 FROM base_hist b LEFT JOIN box_v x ON x.game_id = b.game_id AND x.is_home = b.is_home
 LEFT JOIN box_v o ON o.game_id = b.game_id AND o.is_home = 1 - b.is_home AND x.game_id IS NOT NULL)"""

_BASIC_EXPRS = FLAG_EXPRS | {"last_10_shots_for_avg": last_mean("shots_for", 10), "last_10_shots_against_avg": last_mean("shots_against", 10)}


def _mixed(names, sched) -> str:
    return ", ".join(
        f"{('s' if n in sched else 'f') + side[0]}.{n} AS {side}_{n}" for side in ("home", "away") for n in names
    )


_SCHED = (*REST, *SPLITS)
_SIDE_JOINS = """
 JOIN form fh ON fh.game_id = d.game_id AND fh.is_home = 1 JOIN form fa ON fa.game_id = d.game_id AND fa.is_home = 0
 JOIN sched sh ON sh.game_id = d.game_id AND sh.is_home = 1 JOIN sched sa ON sa.game_id = d.game_id AND sa.is_home = 0"""

SQL_BASIC = with_views(
    "games_v box_v",
    _BASIC_HIST + "," + _form_sql("hist", _BASIC_EXPRS) + "," + _sched_cte() + f"""
SELECT d.game_id, CAST(d.game_date AS VARCHAR) AS date, d.home_team, d.away_team,
 CAST(CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS BIGINT) AS home_win, {_mixed(BASIC, _SCHED)}
FROM done d {_SIDE_JOINS}""",
)


def _diff_sql() -> str:
    return ", ".join(
        f"{r4(f'CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)')} AS {n}" for n, (a, b) in history.diff_pairs().items()
    )


SQL_MERGED = with_views(
    "games_v box_v plays_v skaters_v goalies_v",
    HIST.format(types="(2, 3)").replace("hist AS (", "base_hist AS (") + "," + _STARTER + "," + _FULL_HIST + ","
    + _form_sql("hist", _full_exprs()) + "," + _sched_cte() + "," + _H2H_CTE + "," + _SERIES_CTE + f""",
wide AS (SELECT d.game_id, d.season, d.game_type, CAST(d.game_date AS VARCHAR) AS game_date, d.home_team, d.away_team,
  d.home_score, d.away_score, CASE WHEN d.home_score > d.away_score THEN d.home_team ELSE d.away_team END AS winner_team,
  CAST(CASE WHEN d.home_score > d.away_score THEN 1 ELSE 0 END AS BIGINT) AS target_home_win,
  {_mixed(history.TEAM_FEATURES, _SCHED)},
  h2h_games_last_365_days, h2h_home_team_win_pct_last_5, h2h_home_team_goal_diff_avg_last_5, {_SERIES_COLS}
 FROM done d {_SIDE_JOINS} JOIN h2h ON h2h.game_id = d.game_id LEFT JOIN ser2 s ON s.game_id = d.game_id)
SELECT *, {_diff_sql()} FROM wide""",
)

# ---- team season stats, last five -----------------------------------------------------------------------------


def team_season_stats(spark, folder):
    done = history.eligible(standin.games(spark, folder))
    box = boxes.with_opponent(
        standin.box_scores(spark, folder), {"powerplay_goals": "opp_pp_goals", "powerplay_opportunities": "opp_pp_opps"}
    )
    lines = history.team_games(done).join(box, ["game_id", "is_home"])
    # the mean of shares is taken over whole ten-thousandths, so it is the same in any row order
    lines = lines.withColumn("faceoff_win_pct", F.rint(F.col("faceoff_win_pct") * 1e4))
    made = boxes.team_season_stats(lines)
    return made.withColumn("faceoff_win", F.rint(F.col("faceoff_win") / 1e4 * 10) / 10)


SQL_TEAM_STATS = with_views(
    "games_v box_v",
    HIST.format(types="(2, 3)") + """
SELECT h.season, h.team, COUNT(*) AS games,
 round_even(avg(goals_for) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS goals_for, round_even(avg(goals_against) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS goals_against,
 round_even(100 * (CAST(SUM(x.powerplay_goals) AS DOUBLE) / nullif(CAST(SUM(x.powerplay_opportunities) AS DOUBLE), 0)) * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS power_play,
 round_even(100 * (1 - CAST(SUM(o.powerplay_goals) AS DOUBLE) / nullif(CAST(SUM(o.powerplay_opportunities) AS DOUBLE), 0)) * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS penalty_kill,
 round_even(avg(x.shots_for) * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS shots_per_game,
 round_even(round_even(100 * avg(round_even(x.faceoff_win_pct * 10000.0::DOUBLE, 0)) * 10.0::DOUBLE, 0) / 10.0::DOUBLE / 10000.0::DOUBLE * 10, 0) / 10.0::DOUBLE AS faceoff_win
FROM hist h JOIN box_v x ON x.game_id = h.game_id AND x.is_home = h.is_home
LEFT JOIN box_v o ON o.game_id = h.game_id AND o.is_home = 1 - h.is_home
WHERE h.game_type = 2 GROUP BY h.season, h.team""",
)

QUERIES = {
    "flag_rolling_form": (flag_rolling_form, SQL_FLAG),
    "rest_and_congestion": (rest_and_congestion, SQL_REST),
    "season_splits": (season_splits, SQL_SPLITS),
    "head_to_head": (head_to_head, SQL_H2H),
    "series_state": (series_state, SQL_SERIES),
    "skater_team_agg": (skater_team_agg, SQL_SKATERS),
    "starter_argmax": (starter_argmax, SQL_STARTER),
    "es_attempt_share": (es_attempt_share, SQL_ES),
    "model_features_25": (model_features_25, SQL_BASIC),
    "merged_features": (merged_features, SQL_MERGED),
    "team_season_stats": (team_season_stats, SQL_TEAM_STATS),
}
