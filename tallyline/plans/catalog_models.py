"""Registered queries that fit models, build serving rows or run streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contest
from ..operators import history, live, models, ratings, scores, serving
from ..session import materialise
from ..sources import standin
from ..streaming import live as streams
from .catalog_form import FLAG_EXPRS, HIST, H2H
from .catalog_live import _final
from .catalog_ratings import _elo_cte
from .catalog_scores import G, HELD_OUT, _logit, rnd
from .views_sql import with_views

HELD = HELD_OUT


def _graded(spark, folder):
    return standin.predictions(spark, folder).filter(contest.is_completed(F.col("game_state")))


def platt_scaling(spark, folder):
    """Slope and bias of the rescaling, with log loss before and after on the held-out season."""
    preds = _graded(spark, folder)
    train, test = preds.filter(F.col("season") < HELD), preds.filter(F.col("season") == HELD)
    (slope,), bias = models.fit_logits(train, ["p_home"])
    scaled = models.blend([slope], bias, ["p_home"])
    loss = lambda p: F.rint(F.avg(scores.log_loss_of(p, F.col("y"))) * 1e4) / 1e4
    return test.agg(
        F.lit(round(slope, 4)).alias("slope"), F.lit(round(bias, 4)).alias("bias"),
        loss(F.col("p_home")).alias("log_loss_before"), loss(scaled).alias("log_loss_after"),
    )


_LLP = "avg(-CASE WHEN y = 1 THEN ln(greatest(least({p}, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) ELSE ln(1 - greatest(least({p}, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) END)"
# Newton steps of the two-parameter logistic likelihood
SQL_PLATT = with_views(
    "preds_v",
    f"""{G}, d AS (SELECT {_logit('p_home')} AS x, y FROM graded WHERE season < {HELD}),
newton AS (
 SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
 UNION ALL
 SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
 FROM (SELECT i, a, b, SUM((p - y) * x) AS ga, SUM(p - y) AS gb, SUM(p * (1 - p) * x * x) AS haa, SUM(p * (1 - p) * x) AS hab, SUM(p * (1 - p)) AS hbb
  FROM (SELECT i, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM newton, d WHERE i < 12) s GROUP BY i, a, b) t),
f AS (SELECT a, b FROM newton WHERE i = 12)
SELECT {rnd('any_value(a)', 4)} AS slope, {rnd('any_value(b)', 4)} AS bias, {rnd(_LLP.format(p='p_home'), 4)} AS log_loss_before,
 {rnd(_LLP.format(p=f"(1 / (1 + exp(-(a * {_logit('p_home')} + b))))"), 4)} AS log_loss_after
FROM graded, f WHERE season = {HELD}""",
    recursive=True,
)


def correction_study(spark, folder):
    return models.correction_study(_graded(spark, folder), HELD, ["p_hgb", "p_logit"])


FORM_FEATURES = ("last_5_win_pct", "last_10_win_pct", "goal_diff_last_10", "season_points_pct_before_game", "rest_days")


def _training(spark, folder):
    games = standin.games(spark, folder)
    done = history.eligible(games)
    rated = ratings.ratings(done)
    rows = history.with_differences(history.score_features(games)).join(rated, "game_id")
    y = (F.col("home_score") > F.col("away_score")).cast("double")
    features = [f"{s}_{c}" for c in FORM_FEATURES for s in ("home", "away")] + ["elo_diff", "elo_prob_home"]
    return rows.select("game_id", "season", "game_date", "game_type", y.alias("y"), *features), features


def walk_forward_logistic(spark, folder):
    """Monthly retrained logistic member over the last full season, from form and ratings."""
    rows, features = _training(spark, folder)
    made = models.walk_forward(rows, features, [HELD], lambda cols, n: {"logit": models.logistic_member(cols, n)})
    return made.select("game_id", "season", F.col("game_date").cast("string").alias("game_date"), "y", "elo_prob_home", "p_logit", "p_home")


def ensemble_upcoming(spark, folder):
    """Members trained on all completed games, their mean, odds and pick for the games to come."""
    games = standin.games(spark, folder)
    train, features = _training(spark, folder)
    members = {"logit": models.logistic_member(features, train.count()), "hgb": models.boosted_member(features, models.BOOSTED, 10)}
    fitted = models.fit_all(members, train, features)
    asked = games.filter(~contest.is_completed(F.col("game_state")))
    rows = serving.upcoming_rows(games, asked, ratings.team_states(history.eligible(games)))
    scored = models.ensemble(fitted, rows, features)
    made = serving.prediction_columns(F.col("p_home"))
    return scored.select("game_id", F.col("game_date").cast("string").alias("game_date"), *[c.alias(n) for n, c in made.items()])


def live_model(spark, folder):
    """In-game trees with isotonic calibration, scored on the games they have not seen."""
    events = live.GameEvents(standin.plays(spark, folder))
    state = live.with_clock(live.running_state(events), F.lit(5))
    state = state.join(live.active_penalties(events), ["game_id", "event_index"])
    preds = standin.predictions(spark, folder)
    rows = models.live_rows(state, preds).join(preds.select("game_id", "y", (F.col("game_type") == 3).cast("int").alias("is_playoff")), "game_id")
    rows = rows.withColumn("period", F.floor(F.col("seconds_elapsed") / 1200) + 1)
    rows = materialise(rows.select("game_id", "event_id", "y", *models.LIVE_FEATURES), "live-rows")
    seen, held = rows.filter(F.col("game_id") % 4 > 0), rows.filter(F.col("game_id") % 4 == 0)
    features = list(models.LIVE_FEATURES)
    fitted = models.fit_live(seen, features, rounds=10)
    scored = models.score_live(fitted, held, features)
    return scored.select("game_id", "event_id", "y", "p_raw", "p")


# ---- serving rows -----------------------------------------------------------------------------------------------

SERVED = ("rest_days", "last_5_win_pct", "last_10_win_pct", "last_5_goals_for_avg", "goal_diff_last_10")


def upcoming_features(spark, folder):
    """Form, head to head and ratings of games not yet played, as of the games finished so far."""
    games = standin.games(spark, folder)
    asked = games.filter(~contest.is_completed(F.col("game_state")))
    rows = serving.upcoming_rows(games, asked, ratings.team_states(history.eligible(games)))
    six = [(F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in ("home_elo_pre", "away_elo_pre", "elo_prob_home", "decay_win_rate_diff")]
    return rows.select(
        "game_id", F.col("game_date").cast("string").alias("game_date"), *[f"{s}_{c}" for s in ("home", "away") for c in SERVED], *H2H, *six,
    )


_AS_OF = """
fut AS (SELECT * FROM games_v WHERE game_state = 'FUT'),
ask AS (SELECT game_id, game_date, home_team AS team, 1 AS is_home FROM fut UNION ALL SELECT game_id, game_date, away_team, 0 FROM fut),
at_day AS (SELECT a.game_id, a.is_home, a.team, a.game_date, COUNT(h.game_id) AS c, MAX(h.game_date) AS last_date FROM ask a LEFT JOIN hist h ON h.team = a.team AND h.game_date < a.game_date GROUP BY ALL),
form AS (SELECT g.game_id, g.is_home, CASE WHEN date_diff('day', any_value(g.last_date), any_value(g.game_date)) > 14 THEN 14.0::DOUBLE ELSE CAST(date_diff('day', any_value(g.last_date), any_value(g.game_date)) AS DOUBLE) END AS rest_days,
  {cols} FROM at_day g LEFT JOIN hist h ON h.team = g.team AND h.rn <= g.c AND h.rn > g.c - 10 GROUP BY g.game_id, g.is_home, g.c),
pairs AS (SELECT f.game_id, f.home_team, h.game_id AS met, h.game_date AS met_on, f.game_date,
   CASE WHEN h.home_team = f.home_team THEN h.home_score - h.away_score ELSE h.away_score - h.home_score END AS diff,
   row_number() OVER (PARTITION BY f.game_id ORDER BY h.game_date DESC, h.game_id DESC) AS r
  FROM fut f JOIN done h ON least(h.home_team, h.away_team) = least(f.home_team, f.away_team) AND greatest(h.home_team, h.away_team) = greatest(f.home_team, f.away_team) AND h.game_date < f.game_date),
h2h AS (SELECT game_id, CAST(COUNT(*) FILTER (WHERE met_on >= game_date - 365) AS DOUBLE) AS h2h_games_last_365_days,
  {win} AS h2h_home_team_win_pct_last_5, {diff} AS h2h_home_team_goal_diff_avg_last_5 FROM pairs GROUP BY game_id),
tr AS (SELECT DISTINCT pool, team FROM (SELECT pool, home_team AS team FROM done UNION ALL SELECT pool, away_team FROM done) x),
l AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY pool ORDER BY k DESC) = 1),
st AS (SELECT tr.team, elo[tr.team + 1] AS e, win[tr.team + 1] AS w FROM tr JOIN l ON l.pool = tr.pool)"""
_SERVED_EXPRS = {k: v for k, v in FLAG_EXPRS.items() if k in SERVED}
SQL_UPCOMING = with_views(
    "games_v",
    _elo_cte().replace("done AS (SELECT * FROM games_v WHERE game_state IN ('OFF', 'FINAL') AND game_type IN (2, 3)),", HIST.format(types="(2, 3)").strip() + ",") + ","
    + _AS_OF.format(
        cols=", ".join(f"{e} AS {n}" for n, e in _SERVED_EXPRS.items()),
        win=rnd("CAST(COUNT(*) FILTER (WHERE r <= 5 AND diff > 0) AS DOUBLE) / COUNT(*) FILTER (WHERE r <= 5)", 4),
        diff=rnd("CAST(SUM(diff) FILTER (WHERE r <= 5) AS DOUBLE) / COUNT(*) FILTER (WHERE r <= 5)", 4),
    ) + "\nSELECT f.game_id, CAST(f.game_date AS VARCHAR) AS game_date, "
    + ", ".join(f"{a}.{c} AS {s}_{c}" for s, a in (("home", "fh"), ("away", "fa")) for c in SERVED)
    + f""", COALESCE(h2h_games_last_365_days, 0) AS h2h_games_last_365_days, h2h_home_team_win_pct_last_5, h2h_home_team_goal_diff_avg_last_5,
 {rnd('sh.e', 6)} AS home_elo_pre, {rnd('sa.e', 6)} AS away_elo_pre, {rnd('1.0::DOUBLE / (pow(10.0::DOUBLE, -(sh.e + 50 - sa.e) / 400.0::DOUBLE) + 1.0::DOUBLE)', 6)} AS elo_prob_home,
 {rnd('sh.w - sa.w', 6)} AS decay_win_rate_diff
FROM fut f JOIN form fh ON fh.game_id = f.game_id AND fh.is_home = 1 JOIN form fa ON fa.game_id = f.game_id AND fa.is_home = 0
LEFT JOIN h2h ON h2h.game_id = f.game_id JOIN st sh ON sh.team = f.home_team JOIN st sa ON sa.team = f.away_team""",
    recursive=True,
)


# ---- streams -------------------------------------------------------------------------------------------------------


def _event_stream(spark, folder):
    schema = standin.table(spark, folder, "events").schema
    events = streams.read_events(spark, folder, schema, "events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.col("event_type")
    named = (
        F.when(kind == "purchase", "goal").when(kind == "click", "shot-on-goal").when(kind == "view", "missed-shot")
        .when(kind == "error", "penalty").otherwise("faceoff")
    )
    return events.select(
        F.col("user_id").alias("game_id"), "event_id", "ts", "value", named.alias("event_type"), F.when(k % 2 == 0, "home").otherwise("away").alias("side"),
        F.when(kind == "error", F.when(k % 5 == 0, 5).otherwise(2)).cast("long").alias("penalty_minutes"),
    )


def stream_game_state(spark, folder):
    """Keyed state over the event stream; its last rows equal the batch state."""
    return streams.latest_game_states(spark, _event_stream(spark, folder))


def _stream_sql() -> str:
    cols = []
    for s in ("home", "away"):
        cols += [
            f"{_final(f'''event_type='goal' AND side='{s}' ''')} AS {s}_score",
            f"{_final(f'''event_type IN ('goal','shot-on-goal') AND side='{s}' ''')} AS {s}_sog",
            f"{_final(f'''event_type IN ('goal','shot-on-goal','missed-shot') AND side='{s}' ''')} AS {s}_shot_attempts",
            f"{_final(f'''event_type='penalty' AND side='{s}' ''')} AS {s}_penalties",
            f"CAST(COALESCE(SUM(penalty_minutes) FILTER (WHERE side='{s}'), 0) AS BIGINT) AS {s}_penalty_minutes",
            f"{_final(f'''event_type='faceoff' AND side='{s}' ''')} AS {s}_faceoff_wins",
        ]
    return ", ".join(cols)


SQL_STREAM_STATE = with_views(
    "plays_v", f"SELECT game_id, COUNT(*) AS event_index, arg_max(event_id, sort_order) AS event_id, {_stream_sql()} FROM plays_v GROUP BY game_id"
)


def stream_late_plays(spark, folder):
    """Hourly windows that the watermark has closed."""
    made = streams.closed_windows(spark, _event_stream(spark, folder))
    return made.select(F.date_format("starts", "yyyy-MM-dd HH:mm:ss").alias("starts"), "event_type", "plays", (F.rint(F.col("value") * 100) / 100).alias("value"))


SQL_LATE = with_views(
    "plays_v",
    f"""e AS (SELECT p.event_type, date_trunc('hour', p.ts) AS starts, x.value FROM plays_v p JOIN events x USING (event_id))
SELECT strftime(starts, '%Y-%m-%d %H:%M:%S') AS starts, event_type, COUNT(*) AS plays, {rnd('SUM(value)', 2)} AS value FROM e
WHERE starts + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
)


def stream_live_scoring(spark, folder):
    """Each streamed event with its game's prior and the fair odds of that prior."""
    priors = standin.predictions(spark, folder).select("game_id", "p_home")
    score = lambda batch: batch.select("event_id", "game_id", "prior", contest.fair_odds(F.col("prior")).alias("home_odds"))
    return streams.scored_events(spark, _event_stream(spark, folder), priors, score)


_Q = "least(greatest(prior, 0.02::DOUBLE), 1 - 0.02::DOUBLE)"
SQL_SCORING = with_views(
    "preds_v",
    f"""s AS (SELECT event_id, user_id AS game_id, COALESCE(p_home, 0.54::DOUBLE) AS prior FROM events LEFT JOIN preds_v ON game_id = user_id)
SELECT event_id, game_id, prior, CAST(round_even(CASE WHEN {_Q} >= 0.5 THEN -100 * {_Q} / (1 - {_Q}) ELSE 100 * (1 - {_Q}) / {_Q} END, 0) AS BIGINT) AS home_odds FROM s""",
)


def stream_ratings(spark, folder):
    """Team states kept by a stream of games equal those of a full replay."""
    schema = standin.table(spark, folder, "orders").schema
    orders = streams.read_stream(spark, folder, schema, "orders.parquet")
    made = streams.rating_stream(spark, standin.games_from(orders, standin.table(spark, folder, "customer")))
    return made.select("pool", "team", "season", *[(F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in ("elo", "decay_gd", "decay_win")])


SQL_STREAM_RATINGS = with_views(
    "games_v",
    _elo_cte() + f""", l AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY pool ORDER BY k DESC) = 1),
teams AS (SELECT DISTINCT pool, team FROM (SELECT pool, home_team AS team FROM done UNION ALL SELECT pool, away_team FROM done) t)
SELECT t.pool, team, ssn[team + 1] AS season, {rnd('elo[team + 1]', 6)} AS elo, {rnd('gd[team + 1]', 6)} AS decay_gd, {rnd('win[team + 1]', 6)} AS decay_win FROM teams t JOIN l ON l.pool = t.pool""",
    recursive=True,
)

QUERIES = {
    "platt_scaling": (platt_scaling, SQL_PLATT),
    "correction_study": (correction_study, None),
    "walk_forward_logistic": (walk_forward_logistic, None),
    "ensemble_upcoming": (ensemble_upcoming, None),
    "live_model": (live_model, None),
    "upcoming_features": (upcoming_features, SQL_UPCOMING),
    "stream_game_state": (stream_game_state, SQL_STREAM_STATE),
    "stream_late_plays": (stream_late_plays, SQL_LATE),
    "stream_live_scoring": (stream_live_scoring, SQL_SCORING),
    "stream_ratings": (stream_ratings, SQL_STREAM_RATINGS),
}
