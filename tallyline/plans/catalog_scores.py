"""Registered queries about scoring, calibration, drift and model boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contest
from ..operators import scores
from ..sources import standin
from .views_sql import with_views

MODELS = ("p_home", "p_logit", "p_hgb", "elo_prob_home")


def rnd(e: str, n: int) -> str:
    scale = f"{10.0**n:.1f}::DOUBLE"
    return f"round_even(({e}) * {scale}, 0) / {scale}"


def _graded(spark, folder):
    return standin.predictions(spark, folder).filter(contest.is_completed(F.col("game_state")))


G = "graded AS (SELECT * FROM preds_v WHERE game_state IN ('OFF', 'FINAL'))"
RIGHT = "CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END"
LONG = G + ", long_v AS (" + " UNION ALL ".join(
    f"SELECT game_id, game_date, season, y, '{m}' AS model, {m} AS p FROM graded" for m in MODELS
) + ")"
LL15 = "-CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) ELSE ln(1 - greatest(least(p, 1 - 1e-15::DOUBLE), 1e-15::DOUBLE)) END"


def _score_sql(p: str = "p") -> str:
    right, ll = RIGHT.replace("(p ", f"({p} "), LL15.replace("(p,", f"({p},")
    return (
        f"COUNT(*) AS games, {rnd(f'100 * avg({right})', 1)} AS accuracy, {rnd(f'avg(({p} - y) * ({p} - y))', 4)} AS brier, "
        f"{rnd(f'avg({ll})', 4)} AS log_loss"
    )


def accuracy_brier_logloss(spark, folder):
    return scores.score(scores.to_long(_graded(spark, folder), list(MODELS), ["y"]), "p", "y", ("model",))


SQL_SCORE = with_views("preds_v", f"{LONG} SELECT model, {_score_sql()}, {rnd('ln(2.0::DOUBLE)', 4)} AS baseline_log_loss FROM long_v GROUP BY model")


def auc(spark, folder):
    return scores.auc(scores.to_long(_graded(spark, folder), list(MODELS), ["y"]))


SQL_AUC = with_views(
    "preds_v",
    LONG + """, ranked AS (SELECT model, y, (rank() OVER (PARTITION BY model ORDER BY p)
   + (COUNT(*) OVER (PARTITION BY model, p) - 1) / 2.0::DOUBLE) AS r FROM long_v)
SELECT model, """ + rnd(
        "(SUM(CASE WHEN y = 1 THEN r END) - SUM(y) * (SUM(y) + 1) / 2.0::DOUBLE) / (SUM(y) * (COUNT(*) - SUM(y)))", 6
    ) + " AS auc FROM ranked GROUP BY model",
)


def reliability_curve(spark, folder):
    long = scores.to_long(_graded(spark, folder), list(MODELS), ["y"])
    return scores.reliability_curve(long, keys=("model",))


_CURVE = LONG + """,
folded AS (SELECT model, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS c, """ + RIGHT + """ AS r FROM long_v),
banded AS (SELECT *, CAST(least(greatest(floor((c - 0.5::DOUBLE) / 0.5::DOUBLE * 10), 0), 9) AS BIGINT) AS band FROM folded),
curve AS (
 SELECT m.model, b.band, CAST(50 + 5 * b.band AS VARCHAR) || '-' || CAST(55 + 5 * b.band AS VARCHAR) || '%' AS "range", COUNT(x.c) AS games,
  """ + rnd("100 * SUM(c) / nullif(COUNT(x.c), 0)", 1) + " AS predicted, " + rnd("100 * (CAST(SUM(r) AS DOUBLE) / nullif(COUNT(x.c), 0))", 1) + " AS actual, " + rnd(
    "100 * (CAST(SUM(r) AS DOUBLE) / nullif(COUNT(x.c), 0)) - 100 * SUM(c) / nullif(COUNT(x.c), 0)", 1
) + """ AS gap
 FROM (SELECT DISTINCT model FROM long_v) m, (SELECT CAST(range AS BIGINT) AS band FROM range(10)) b
 LEFT JOIN banded x ON x.model = m.model AND x.band = b.band GROUP BY m.model, b.band)"""
SQL_CURVE = with_views("preds_v", _CURVE + " SELECT * FROM curve")


def ece(spark, folder):
    return scores.calibration_error(reliability_curve(spark, folder), ("model",))


SQL_ECE = with_views("preds_v", _CURVE + " SELECT model, " + rnd("SUM(games * abs(gap)) / SUM(games)", 2) + " AS ece FROM curve GROUP BY model")


# the sample: published seasons against the slate not yet played
BASELINE_SEASON = 19992000


def _reference(preds):
    return preds.filter(contest.is_completed(F.col("game_state")) & (F.col("season") <= BASELINE_SEASON))


def _live(preds):
    return preds.filter(contest.is_completed(F.col("game_state")) & (F.col("season") > BASELINE_SEASON))


def _upcoming(preds):
    return preds.filter(~contest.is_completed(F.col("game_state")))


def psi_drift(spark, folder):
    """Stability of every model's probabilities, published seasons against the slate: one read, one aggregation."""
    done = contest.is_completed(F.col("game_state"))
    now = F.when(~done, 1).when(F.col("season") <= BASELINE_SEASON, 0)
    preds = standin.predictions(spark, folder).withColumn("now", now).filter(F.col("now").isNotNull())
    made = scores.psi_of(scores.to_long(preds, list(MODELS), ["now"]), keys=("model",))
    return made.withColumn("verdict", scores.drift_verdict(F.col("psi")))


def _psi_sql(reference: str, current: str) -> str:
    band = "CASE WHEN p < 0.35 THEN 0 WHEN p < 0.45 THEN 1 WHEN p < 0.5 THEN 2 WHEN p < 0.55 THEN 3 WHEN p < 0.65 THEN 4 ELSE 5 END"
    return f"""
tagged AS (SELECT model, 0 AS cur, {band} AS band FROM {reference} UNION ALL SELECT model, 1, {band} FROM {current}),
n AS (SELECT model, SUM(1 - cur) AS nr, SUM(cur) AS nc FROM tagged GROUP BY model),
per AS (SELECT n.model, nr, nc, b.band,
  greatest(CAST(COUNT(t.band) FILTER (WHERE t.cur = 0) AS DOUBLE) / nr, 0.5::DOUBLE / greatest(nr, nc)) AS e,
  greatest(CAST(COUNT(t.band) FILTER (WHERE t.cur = 1) AS DOUBLE) / nc, 0.5::DOUBLE / greatest(nr, nc)) AS a
  FROM n CROSS JOIN (SELECT range AS band FROM range(6)) b LEFT JOIN tagged t ON t.model = n.model AND t.band = b.band
  GROUP BY n.model, nr, nc, b.band),
psi AS (SELECT model, CAST(nr AS BIGINT) AS reference_games, CAST(nc AS BIGINT) AS current_games, {rnd('SUM((a - e) * ln(a / e))', 4)} AS psi FROM per GROUP BY model, nr, nc)"""


ALL_LONG = "all_long AS (" + " UNION ALL ".join(f"SELECT game_state, season, y, '{m}' AS model, {m} AS p FROM preds_v" for m in MODELS) + f"""),
ref_v AS (SELECT * FROM all_long WHERE game_state = 'OFF' AND season <= {BASELINE_SEASON}),
live_v AS (SELECT * FROM all_long WHERE game_state = 'OFF' AND season > {BASELINE_SEASON}),
up_v AS (SELECT * FROM all_long WHERE game_state = 'FUT')"""
VERDICT = "CASE WHEN psi IS NULL THEN 'unknown' WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'watch' ELSE 'shifted' END"
SQL_PSI = with_views("preds_v", ALL_LONG + "," + _psi_sql("ref_v", "up_v") + f" SELECT *, {VERDICT} AS verdict FROM psi")


def drift_report(spark, folder):
    preds = standin.predictions(spark, folder)
    return scores.drift_report(_reference(preds).select(F.col("p_home").alias("p")), _upcoming(preds).select(F.col("p_home").alias("p")))


_REPORT = f"""SELECT reference_games, current_games, CASE WHEN reference_games >= 30 AND current_games >= 30 THEN psi END AS psi,
 CASE WHEN reference_games >= 30 AND current_games >= 30 THEN {VERDICT} ELSE 'unknown' END AS verdict,
 current_games < 100 OR reference_games < 30 AS provisional,
 CASE WHEN reference_games < 30 OR current_games < 30 THEN 'too few games: 30 are wanted in each sample'
      WHEN current_games < 100 THEN CAST(current_games AS VARCHAR) || ' current games, a first reading'
      ELSE CAST(current_games AS VARCHAR) || ' current games' END AS note FROM psi WHERE model = 'p_home'"""
SQL_DRIFT = with_views("preds_v", ALL_LONG + "," + _psi_sql("ref_v", "up_v") + _REPORT)


def monitoring_summary(spark, folder):
    """Reference, live and drift sections of the monitoring report as one row; the slate falls back to live games."""
    preds = standin.predictions(spark, folder)
    done = contest.is_completed(F.col("game_state"))
    first = preds.filter(done).agg(F.min("season").alias("baseline_season")).scalar()
    section = F.when(~done, "slate").when(F.col("season") <= first, "ref").otherwise("live")
    rows = preds.select(section.alias("section"), F.col("p_home").alias("p"), "y")
    return scores.monitoring(rows).select(first.alias("baseline_season"), "*")


SQL_MONITOR = with_views(
    "preds_v",
    f"""base AS (SELECT MIN(season) AS baseline_season FROM preds_v WHERE game_state = 'OFF'),
all_long AS (SELECT game_state, season, y, 'p_home' AS model, p_home AS p FROM preds_v),
ref_v AS (SELECT * FROM all_long, base WHERE game_state = 'OFF' AND season <= baseline_season),
live_v AS (SELECT * FROM all_long, base WHERE game_state = 'OFF' AND season > baseline_season),
up_v AS (SELECT model, p FROM all_long WHERE game_state = 'FUT'
  UNION ALL SELECT model, p FROM live_v WHERE NOT EXISTS (SELECT 1 FROM all_long WHERE game_state = 'FUT')),
s AS (SELECT 'ref' AS k, {_score_sql()} FROM ref_v UNION ALL SELECT 'live', {_score_sql()} FROM live_v),
b AS (SELECT k, floor((c - 0.5::DOUBLE) / 0.5::DOUBLE * 10) AS band, COUNT(*) AS n, {rnd('100 * (CAST(SUM(r) AS DOUBLE) / COUNT(*)) - 100 * SUM(c) / COUNT(*)', 1)} AS gap
  FROM (SELECT 'ref' AS k, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS c, {RIGHT} AS r FROM ref_v
        UNION ALL SELECT 'live', CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, {RIGHT} FROM live_v) t GROUP BY k, band),
e AS (SELECT k, {rnd('SUM(n * abs(gap)) / SUM(n)', 2)} AS ece FROM b GROUP BY k),""" + _psi_sql("ref_v", "up_v") + f""",
j AS (SELECT l.games AS live_games, r.games AS ref_games, CASE WHEN l.games >= 30 THEN l.accuracy END AS live_accuracy,
   CASE WHEN r.games >= 30 THEN r.accuracy END AS ref_accuracy,
   CASE WHEN l.games >= 30 AND r.games >= 30 THEN {rnd('l.accuracy - r.accuracy', 1)} END AS delta,
   CASE WHEN r.games >= 30 THEN er.ece END AS ref_ece, CASE WHEN r.games >= 30 THEN r.log_loss END AS ref_log_loss,
   CASE WHEN l.games >= 30 THEN el.ece END AS live_ece, CASE WHEN l.games >= 30 THEN l.log_loss END AS live_log_loss
 FROM s l JOIN s r ON l.k = 'live' AND r.k = 'ref' JOIN e el ON el.k = 'live' JOIN e er ON er.k = 'ref')
SELECT baseline_season, j.*, CASE WHEN delta IS NULL THEN 'warming-up' WHEN delta < -5 THEN 'below-baseline' WHEN delta > 5 THEN 'above-baseline' ELSE 'on-track' END AS status,
  CASE WHEN reference_games >= 30 AND current_games >= 30 THEN psi END AS psi,
  CASE WHEN reference_games >= 30 AND current_games >= 30 THEN {VERDICT} ELSE 'unknown' END AS drift_verdict,
  current_games < 100 OR reference_games < 30 AS provisional, current_games AS drift_games
FROM base, j, psi""",
)


def season_scorecard(spark, folder):
    return scores.season_scorecard(_graded(spark, folder))


SQL_SCORECARD = with_views(
    "preds_v",
    f"""{G} SELECT COALESCE(CAST(season AS VARCHAR), 'ALL') AS season, {_score_sql('p_home')}, {rnd('avg(p_home)', 3)} AS mean_prediction,
 {rnd('stddev_pop(p_home)', 3)} AS spread, {rnd('100 * avg(y)', 1)} AS home_win_rate FROM graded GROUP BY ROLLUP(season)""",
)


def confidence_buckets(spark, folder):
    return scores.confidence_buckets(_graded(spark, folder))


_CONF = "greatest(p_home, 1 - p_home)"
SQL_BUCKETS = with_views(
    "preds_v",
    f"""{G} SELECT CASE WHEN {_CONF} < 0.55 THEN '50-55%' WHEN {_CONF} < 0.6 THEN '55-60%' WHEN {_CONF} < 0.65 THEN '60-65%'
  WHEN {_CONF} < 0.7 THEN '65-70%' ELSE '70-100%' END AS "range", COUNT(*) AS games, {rnd('100 * avg(' + RIGHT.replace('(p ', '(p_home ') + ')', 1)} AS accuracy
 FROM graded GROUP BY 1""",
)


def threshold_report(spark, folder):
    return scores.threshold_report(_graded(spark, folder))


_TH = ", ".join(f"({t}::DOUBLE)" for t in scores.THRESHOLDS)
SQL_THRESHOLD = with_views(
    "preds_v",
    f"""{G}, t AS (SELECT * FROM (VALUES {_TH}) v(min_conf))
SELECT min_conf, {rnd('CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM graded)', 4)} AS coverage, COUNT(*) AS picks,
 {rnd('CAST(SUM(' + RIGHT.replace('(p ', '(p_home ') + ') AS DOUBLE) / COUNT(*)', 4)} AS win_rate
FROM t JOIN graded ON {_CONF} >= min_conf GROUP BY min_conf""",
)


def monthly_accuracy(spark, folder):
    return scores.monthly_accuracy(_graded(spark, folder))


SQL_MONTHLY = with_views(
    "preds_v",
    f"{G} SELECT strftime(game_date, '%Y-%m') AS month, COUNT(*) AS games, {rnd('100 * avg(' + RIGHT.replace('(p ', '(p_home ') + ')', 1)} AS accuracy FROM graded GROUP BY 1",
)


def model_leaderboard(spark, folder):
    return scores.model_board(_graded(spark, folder), {m: scores.MODEL_LABELS[m] for m in MODELS})


_LABEL = "CASE model " + " ".join(f"WHEN '{m}' THEN '{scores.MODEL_LABELS[m]}'" for m in MODELS) + " END"
_PLACE = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS)) + " END"
_FLOORED = "-(y * ln(greatest(p, 1e-9::DOUBLE)) + (1 - y) * ln(greatest(1 - p, 1e-9::DOUBLE)))"
_RUNS = f"""
marked AS (SELECT *, {RIGHT} AS r, row_number() OVER (PARTITION BY model ORDER BY game_date, game_id) AS n FROM long_v),
islands AS (SELECT *, n - row_number() OVER (PARTITION BY model, r ORDER BY game_date, game_id) AS island FROM marked),
runs AS (SELECT model, MAX(len) AS best_streak FROM (SELECT model, island, COUNT(*) AS len FROM islands WHERE r = 1 GROUP BY model, island) t GROUP BY model)"""
SQL_BOARD = with_views(
    "preds_v",
    LONG + "," + _RUNS + f""",
totals AS (SELECT model, {rnd(f'100 * avg({RIGHT})', 1)} AS accuracy, {rnd(f'avg({_FLOORED})', 4)} AS log_loss,
  CAST(SUM({RIGHT}) AS BIGINT) AS correct_picks, COUNT(*) AS games FROM long_v GROUP BY model)
SELECT {_LABEL} AS model, accuracy, log_loss, correct_picks, games, best_streak, row_number() OVER (ORDER BY accuracy DESC, {_PLACE}) AS rank
FROM totals JOIN runs USING (model)""",
)


def longest_streak(spark, folder):
    return scores.longest_runs(_graded(spark, folder), list(MODELS))


SQL_LONGEST = with_views("preds_v", LONG + "," + _RUNS + " SELECT * FROM runs")

HELD_OUT = 20002001


def adaptive_home_grid(spark, folder):
    return scores.home_rate_grid(_graded(spark, folder).filter(F.col("season") < HELD_OUT))


def _logit(p: str) -> str:
    q = f"greatest(least({p}, 1 - 1e-9::DOUBLE), 1e-9::DOUBLE)"
    return f"CASE WHEN {p} IS NULL THEN NULL ELSE ln({q} / (1 - {q})) END"


_GRID_W = ", ".join(
    f"CASE WHEN n > {w} THEN SUM(y) OVER (ORDER BY n ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) / {w}.0::DOUBLE END AS r{w}"
    for w in scores.GRID_WINDOWS
)
_GRID_L = " UNION ALL ".join(
    f"SELECT {i} AS pos, CAST({w} AS BIGINT) AS \"window\", {s}::DOUBLE AS strength, "
    f"1 / (1 + exp(-({_logit('p_home')} + COALESCE({s}::DOUBLE * ({_logit(f'r{w}')} - {_logit('0.544::DOUBLE')}), 0)))) AS p, y FROM rolled"
    for i, (w, s) in enumerate([(w, s) for w in scores.GRID_WINDOWS for s in scores.GRID_STRENGTHS])
)
SQL_GRID = with_views(
    "preds_v",
    f"""{G}, ordered AS (SELECT *, row_number() OVER (ORDER BY game_date, game_id) AS n FROM graded WHERE season < {HELD_OUT}),
rolled AS (SELECT p_home, y, {_GRID_W} FROM ordered), cells AS ({_GRID_L}),
losses AS (SELECT pos, "window", strength, {rnd(f'avg({LL15})', 6)} AS log_loss FROM cells GROUP BY pos, "window", strength)
SELECT "window", strength, log_loss, row_number() OVER (ORDER BY log_loss, pos) = 1 AS best FROM losses""",
)


def walk_forward_base_rate(spark, folder):
    made = scores.walk_forward_base_rate(_graded(spark, folder))
    return made.select(
        "game_id", "season", F.col("month_start").cast("string").alias("month_start"), "train_rows",
        (F.rint(F.col("p_base") * 1e6) / 1e6).alias("p_base"), "y",
    )


SQL_WALK = with_views(
    "preds_v",
    f"""{G}, months AS (SELECT DISTINCT CAST(date_trunc('month', game_date) AS DATE) AS month_start FROM graded),
folds AS (SELECT m.month_start, COUNT(*) AS train_rows, {rnd('CAST(SUM(y) AS DOUBLE) / COUNT(*)', 6)} AS p_base
  FROM months m JOIN graded g ON g.game_date < m.month_start GROUP BY m.month_start HAVING COUNT(*) >= 2000)
SELECT g.game_id, g.season, CAST(f.month_start AS VARCHAR) AS month_start, f.train_rows, f.p_base, g.y
FROM graded g JOIN folds f ON f.month_start = CAST(date_trunc('month', g.game_date) AS DATE)""",
)


def fair_odds(spark, folder):
    p = F.col("p_home")
    return standin.predictions(spark, folder).select(
        "game_id",
        contest.fair_odds(p).alias("home_odds"),
        contest.fair_odds(1 - p).alias("away_odds"),
        contest.fair_odds(p, 0.01).alias("home_odds_export"),
        contest.fair_odds(1 - p, 0.01).alias("away_odds_export"),
    )


def _odds_sql(p: str, low: str) -> str:
    q = f"least(greatest({p}, {low}::DOUBLE), 1 - {low}::DOUBLE)"
    return f"CAST(round_even(CASE WHEN {q} >= 0.5 THEN -100 * {q} / (1 - {q}) ELSE 100 * (1 - {q}) / {q} END, 0) AS BIGINT)"


SQL_ODDS = with_views(
    "preds_v",
    f"""SELECT game_id, {_odds_sql('p_home', '0.02')} AS home_odds, {_odds_sql('(1 - p_home)', '0.02')} AS away_odds,
 {_odds_sql('p_home', '0.01')} AS home_odds_export, {_odds_sql('(1 - p_home)', '0.01')} AS away_odds_export FROM preds_v""",
)


def pick_confidence(spark, folder):
    p, y = F.col("p_home"), F.col("y")
    return _graded(spark, folder).select(
        "game_id",
        F.when(contest.pick_home(p), F.col("home_team")).otherwise(F.col("away_team")).alias("pick"),
        (F.rint(contest.confidence(p) * 1e6) / 1e6).alias("confidence"),
        contest.is_right(p, y).alias("correct"),
    )


SQL_PICK = with_views(
    "preds_v",
    f"""{G} SELECT game_id, CASE WHEN p_home >= 0.5 THEN home_team ELSE away_team END AS pick, {rnd(_CONF, 6)} AS confidence,
 (p_home >= 0.5) = (y = 1) AS correct FROM graded""",
)

QUERIES = {
    "accuracy_brier_logloss": (accuracy_brier_logloss, SQL_SCORE),
    "auc": (auc, SQL_AUC),
    "reliability_curve": (reliability_curve, SQL_CURVE),
    "ece": (ece, SQL_ECE),
    "psi_drift": (psi_drift, SQL_PSI),
    "drift_report": (drift_report, SQL_DRIFT),
    "monitoring_summary": (monitoring_summary, SQL_MONITOR),
    "season_scorecard": (season_scorecard, SQL_SCORECARD),
    "confidence_buckets": (confidence_buckets, SQL_BUCKETS),
    "threshold_report": (threshold_report, SQL_THRESHOLD),
    "monthly_accuracy": (monthly_accuracy, SQL_MONTHLY),
    "model_leaderboard": (model_leaderboard, SQL_BOARD),
    "longest_streak": (longest_streak, SQL_LONGEST),
    "adaptive_home_grid": (adaptive_home_grid, SQL_GRID),
    "walk_forward_base_rate": (walk_forward_base_rate, SQL_WALK),
    "fair_odds": (fair_odds, SQL_ODDS),
    "pick_confidence": (pick_confidence, SQL_PICK),
}
