"""Registered queries about ratings, decayed form and season positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contest
from ..operators import history, matchups, ratings
from ..sources import standin
from .catalog_form import HIST
from .catalog_scores import rnd
from .views_sql import with_views


def _six(df, skip):
    return df.select(*[F.col(c) if c in skip else (F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in df.columns])


def elo_ratings(spark, folder):
    made = ratings.ratings(history.eligible(standin.games(spark, folder)))
    return _six(made, ("game_id",))


# One recursion step plays the next game of every pool; a pool carries one list per value, indexed by team.
_DONE = "done AS (SELECT * FROM games_v WHERE game_state IN ('OFF', 'FINAL') AND game_type IN (2, 3))"


def _elo_cte() -> str:
    upd = lambda lst, h, a: (
        f"list_transform({lst}, lambda x, i: CASE WHEN i = g.home_team + 1 THEN {h} WHEN i = g.away_team + 1 THEN {a} ELSE x END)"
    )
    return f"""{_DONE},
seq AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY game_date, game_id) AS k FROM done),
step AS (
 SELECT pool, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS game_id, CAST(NULL AS DOUBLE) AS he, CAST(NULL AS DOUBLE) AS ae,
   CAST(NULL AS DOUBLE) AS hg, CAST(NULL AS DOUBLE) AS ag, CAST(NULL AS DOUBLE) AS hw, CAST(NULL AS DOUBLE) AS aw,
   list_transform(range(25), lambda x: 1505.0::DOUBLE) AS elo, list_transform(range(25), lambda x: 0.0::DOUBLE) AS gd,
   list_transform(range(25), lambda x: 0.5::DOUBLE) AS win, list_transform(range(25), lambda x: CAST(0 AS BIGINT)) AS ssn
 FROM (SELECT DISTINCT pool FROM done) p
 UNION ALL
 SELECT pool, k, game_id, he, ae, hg, ag, hw, aw,
   {upd("elo", "he + shift", "ae - shift")}, {upd("gd", "0.95::DOUBLE * hg + 0.05::DOUBLE * gdiff", "0.95::DOUBLE * ag - 0.05::DOUBLE * gdiff")},
   {upd("win", "0.95::DOUBLE * hw + 0.05::DOUBLE * won", "0.95::DOUBLE * aw + 0.05::DOUBLE * (1 - won)")}, {upd("ssn", "season", "season")}
 FROM (
  SELECT *, CASE WHEN game_type = 3 THEN 7.5::DOUBLE ELSE 6.0::DOUBLE END
     * (0.6686::DOUBLE * ln(greatest(abs(gdiff), 1.0::DOUBLE)) + 0.8048::DOUBLE)
     * (2.05::DOUBLE / ((CASE WHEN won = 1 THEN gap ELSE -gap END) * 0.001::DOUBLE + 2.05::DOUBLE))
     * (won - 1.0::DOUBLE / (pow(10.0::DOUBLE, -gap / 400.0::DOUBLE) + 1.0::DOUBLE)) AS shift
  FROM (
   SELECT *, he + 50.0::DOUBLE - ae AS gap FROM (
    SELECT s.pool, s.elo, s.gd, s.win, s.ssn, n.k, n.game_id, n.season, n.game_type, n.home_team, n.away_team,
      CAST(n.home_score - n.away_score AS DOUBLE) AS gdiff, CASE WHEN n.home_score > n.away_score THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS won,
      CASE WHEN s.ssn[n.home_team + 1] NOT IN (0, n.season) THEN 1505 + (s.elo[n.home_team + 1] - 1505) * 0.7::DOUBLE ELSE s.elo[n.home_team + 1] END AS he,
      CASE WHEN s.ssn[n.away_team + 1] NOT IN (0, n.season) THEN 1505 + (s.elo[n.away_team + 1] - 1505) * 0.7::DOUBLE ELSE s.elo[n.away_team + 1] END AS ae,
      CASE WHEN s.ssn[n.home_team + 1] NOT IN (0, n.season) THEN s.gd[n.home_team + 1] * 0.5::DOUBLE ELSE s.gd[n.home_team + 1] END AS hg,
      CASE WHEN s.ssn[n.away_team + 1] NOT IN (0, n.season) THEN s.gd[n.away_team + 1] * 0.5::DOUBLE ELSE s.gd[n.away_team + 1] END AS ag,
      CASE WHEN s.ssn[n.home_team + 1] NOT IN (0, n.season) THEN 0.5::DOUBLE + (s.win[n.home_team + 1] - 0.5::DOUBLE) * 0.5::DOUBLE ELSE s.win[n.home_team + 1] END AS hw,
      CASE WHEN s.ssn[n.away_team + 1] NOT IN (0, n.season) THEN 0.5::DOUBLE + (s.win[n.away_team + 1] - 0.5::DOUBLE) * 0.5::DOUBLE ELSE s.win[n.away_team + 1] END AS aw
    FROM step s JOIN seq n ON n.pool = s.pool AND n.k = s.k + 1) a) b) g)"""


_TEN = f"""game_id, {rnd('he', 6)} AS home_elo_pre, {rnd('ae', 6)} AS away_elo_pre, {rnd('he - ae', 6)} AS elo_diff,
 {rnd('1.0::DOUBLE / (pow(10.0::DOUBLE, -(he + 50 - ae) / 400.0::DOUBLE) + 1.0::DOUBLE)', 6)} AS elo_prob_home,
 {rnd('hg', 6)} AS home_decay_goal_diff, {rnd('ag', 6)} AS away_decay_goal_diff, {rnd('hw', 6)} AS home_decay_win_rate, {rnd('aw', 6)} AS away_decay_win_rate,
 {rnd('hg - ag', 6)} AS decay_goal_diff_diff, {rnd('hw - aw', 6)} AS decay_win_rate_diff"""
SQL_ELO = with_views("games_v", _elo_cte() + f" SELECT {_TEN} FROM step WHERE game_id IS NOT NULL", recursive=True)

AS_OF = "1999-12-31"
CURRENT_SEASON = 20012002


def elo_catch_up(spark, folder):
    """Ratings saved at a date, caught up with the games since, and brought into the current season."""
    done = history.eligible(standin.games(spark, folder))
    saved = ratings.team_states(done.filter(F.col("game_date") <= F.lit(AS_OF).cast("date")))
    now = ratings.enter_season(ratings.catch_up(saved, done, AS_OF), CURRENT_SEASON)
    return _six(now, ("pool", "team", "season"))


SQL_CATCH_UP = with_views(
    "games_v",
    _elo_cte() + f""", last_step AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY pool ORDER BY k DESC) = 1),
teams AS (SELECT DISTINCT pool, team FROM (SELECT pool, home_team AS team FROM done UNION ALL SELECT pool, away_team FROM done) t),
state AS (SELECT t.pool, team, elo[team + 1] AS e, gd[team + 1] AS g, win[team + 1] AS w, ssn[team + 1] AS s FROM teams t JOIN last_step l ON l.pool = t.pool)
SELECT pool, team, CAST({CURRENT_SEASON} AS BIGINT) AS season,
 {rnd(f'CASE WHEN s <> {CURRENT_SEASON} THEN 1505 + (e - 1505) * 0.7::DOUBLE ELSE e END', 6)} AS elo,
 {rnd(f'CASE WHEN s <> {CURRENT_SEASON} THEN g * 0.5::DOUBLE ELSE g END', 6)} AS decay_gd,
 {rnd(f'CASE WHEN s <> {CURRENT_SEASON} THEN 0.5::DOUBLE + (w - 0.5::DOUBLE) * 0.5::DOUBLE ELSE w END', 6)} AS decay_win FROM state""",
    recursive=True,
)


def decay_form(spark, folder):
    done = history.eligible(standin.games(spark, folder))
    made = ratings.decayed_form(history.team_games(done))
    # rounded to 24 binary places: the values are decimals, which tie at decimal places but never at binary ones
    return made.select("game_id", "team", *[(F.rint(F.col(c) * 2**24) / 2**24).alias(c) for c in made.columns[2:]])


SQL_DECAY = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + f""",
step AS (
 SELECT h.team, h.rn, h.game_id, h.season, 0.0::DOUBLE AS g, 0.5::DOUBLE AS w, h.goals_for - h.goals_against AS m, h.win FROM hist h WHERE h.rn = 1
 UNION ALL
 SELECT n.team, n.rn, n.game_id, n.season,
  (0.95::DOUBLE * s.g + 0.05::DOUBLE * s.m) * CASE WHEN n.season <> s.season THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END,
  0.5::DOUBLE + (0.95::DOUBLE * s.w + 0.05::DOUBLE * s.win - 0.5::DOUBLE) * CASE WHEN n.season <> s.season THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END,
  n.goals_for - n.goals_against, n.win FROM step s JOIN hist n ON n.team = s.team AND n.rn = s.rn + 1)
SELECT game_id, team, round_even(g * 16777216, 0) / 16777216 AS decay_goal_diff, round_even(w * 16777216, 0) / 16777216 AS decay_win_rate FROM step""",
    recursive=True,
)


def season_game_index(spark, folder):
    made = ratings.season_game_index(standin.games(spark, folder))
    return made.select("game_id", "season", "season_game_index")


SQL_INDEX = with_views(
    "games_v",
    "SELECT game_id, season, row_number() OVER (PARTITION BY season ORDER BY game_date, game_id) - 1 AS season_game_index FROM games_v",
)


def elo_accuracy(spark, folder):
    """Accuracy of the rating alone: pick the side above one half."""
    done = history.eligible(standin.games(spark, folder))
    rated = ratings.ratings(done).join(done.select("game_id", "home_score", "away_score"), "game_id")
    right = contest.is_right(F.col("elo_prob_home"), (F.col("home_score") > F.col("away_score")).cast("int"))
    return rated.agg(F.count(F.lit(1)).alias("games"), (F.rint(F.avg(right.cast("int")) * 1e4) / 1e4).alias("accuracy"))


SQL_ELO_ACC = with_views(
    "games_v",
    _elo_cte() + f""" SELECT COUNT(*) AS games, {rnd("avg(CASE WHEN (he + 50 - ae >= 0) = (d.home_score > d.away_score) THEN 1 ELSE 0 END)", 4)} AS accuracy
FROM step JOIN done d ON d.game_id = step.game_id""",
    recursive=True,
)


def rating_zero_sum(spark, folder):
    """Quality check: what one side gains the other loses, in every game, by the ratings the fold emitted."""
    return ratings.unbalanced(ratings.rating_changes(history.eligible(standin.games(spark, folder))))


SQL_ZERO = with_views(
    "games_v",
    _elo_cte() + """ SELECT COUNT(*) AS games,
 CAST(SUM(CASE WHEN abs((elo[d.home_team + 1] - he) + (elo[d.away_team + 1] - ae)) > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS unbalanced
FROM step JOIN done d ON d.game_id = step.game_id""",
    recursive=True,
)


def asof_latest_features(spark, folder):
    """Each team's form as of its latest game row, home before away on one date."""
    made = history.score_features(standin.games(spark, folder))
    names = ["last_5_win_pct", "last_10_win_pct", "goal_diff_last_10"]
    out = matchups.latest_features(made, names)
    return out.withColumn("source_date", F.col("source_date").cast("string"))


from .catalog_form import FLAG_EXPRS, _form_sql  # noqa: E402

SQL_ASOF = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + "," + _form_sql("hist", FLAG_EXPRS) + """
SELECT h.team, h.game_id AS source_game_id, CAST(h.game_date AS VARCHAR) AS source_date, f.last_5_win_pct, f.last_10_win_pct, f.goal_diff_last_10
FROM hist h JOIN form f ON f.game_id = h.game_id AND f.is_home = h.is_home
QUALIFY row_number() OVER (PARTITION BY h.team ORDER BY h.game_date DESC, h.is_home DESC, h.game_id DESC) = 1""",
)


def serving_latest_features(spark, folder):
    """Carried-forward features for serving: regular-season rows first, then the latest date and id."""
    made = history.score_features(standin.games(spark, folder))
    names = ["last_5_win_pct", "last_10_win_pct", "goal_diff_last_10"]
    out = matchups.latest_features(made, names, prefer_regular=True)
    return out.withColumn("source_date", F.col("source_date").cast("string"))


SQL_SERVING = SQL_ASOF.replace(
    "ORDER BY h.game_date DESC, h.is_home DESC, h.game_id DESC",
    "ORDER BY CASE WHEN h.game_type = 2 THEN 0 ELSE 1 END, h.game_date DESC, h.game_id DESC, h.is_home DESC",
)

from .catalog_form import (  # noqa: E402
    _FULL_HIST, _H2H_CTE, _SERIES_CTE, _SERIES_COLS, _SIDE_JOINS, _SCHED, _STARTER, _diff_sql, _full_exprs, _mixed, _sched_cte, completed_games, full_form, merged_columns, paired, with_form,
)


def model_dataset(spark, folder):
    """The full training table: merged features, ten rating columns, season position and the playoff flag."""
    done = completed_games(spark, folder)
    rated = _six(ratings.ratings(done), ("game_id",))
    # rows are joined on the game while they are narrow, the many form columns come last
    narrow = ratings.model_dataset(paired(done), rated, done)
    made = with_form(narrow, full_form(spark, folder, done))
    return made.select(*merged_columns(), *[c for c in rated.columns if c != "game_id"], "season_game_index", "is_playoff")


SQL_DATASET = with_views(
    "games_v box_v plays_v skaters_v goalies_v",
    HIST.format(types="(2, 3)").replace("hist AS (", "base_hist AS (") + "," + _STARTER + "," + _FULL_HIST + "," + _form_sql("hist", _full_exprs()) + ","
    + _sched_cte() + "," + _H2H_CTE + "," + _SERIES_CTE + "," + _elo_cte().removeprefix(_DONE + ",") + f""",
wide AS (SELECT d.game_id, d.season, d.game_type, CAST(d.game_date AS VARCHAR) AS game_date, d.home_team, d.away_team,
  d.home_score, d.away_score, CASE WHEN d.home_score > d.away_score THEN d.home_team ELSE d.away_team END AS winner_team,
  CAST(CASE WHEN d.home_score > d.away_score THEN 1 ELSE 0 END AS BIGINT) AS target_home_win,
  {_mixed(history.TEAM_FEATURES, _SCHED)},
  h2h_games_last_365_days, h2h_home_team_win_pct_last_5, h2h_home_team_goal_diff_avg_last_5, {_SERIES_COLS}
 FROM done d {_SIDE_JOINS} JOIN h2h ON h2h.game_id = d.game_id LEFT JOIN ser2 s ON s.game_id = d.game_id),
ten AS (SELECT {_TEN} FROM step WHERE game_id IS NOT NULL)
SELECT w.*, {_diff_sql()}, t.* EXCLUDE (game_id), row_number() OVER (PARTITION BY season ORDER BY game_date, w.game_id) - 1 AS season_game_index,
 CAST(game_type = 3 AS BIGINT) AS is_playoff FROM wide w JOIN ten t ON t.game_id = w.game_id""",
    recursive=True,
)

QUERIES = {
    "model_dataset": (model_dataset, SQL_DATASET),
    "elo_ratings": (elo_ratings, SQL_ELO),
    "elo_catch_up": (elo_catch_up, SQL_CATCH_UP),
    "decay_form": (decay_form, SQL_DECAY),
    "season_game_index": (season_game_index, SQL_INDEX),
    "elo_accuracy": (elo_accuracy, SQL_ELO_ACC),
    "rating_zero_sum": (rating_zero_sum, SQL_ZERO),
    "asof_latest_features": (asof_latest_features, SQL_ASOF),
    "serving_latest_features": (serving_latest_features, SQL_SERVING),
}
