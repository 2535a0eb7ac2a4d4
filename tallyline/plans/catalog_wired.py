"""Registered queries that join predictions, serving rows, filters and stored settings the way a site uses them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import calendar, contest
from ..operators import board, history, quality, ratings, scores, serving
from ..sources import standin
from .catalog_board import GRADED
from .catalog_models import SERVED, SQL_UPCOMING
from .catalog_scores import rnd
from .views_sql import with_views

# ---- filters ---------------------------------------------------------------------------------------------------

FILTERS = ("all", "correct", "missed", "playoffs")
# the first page, one further on, and one behind the last
PAGES = (1, 3, 10_000_000)


def result_filters(spark, folder):
    """Places of the games on three pages of every result filter."""
    preds = standin.predictions(spark, folder)
    made = [
        board.results_page(preds, only, page).select(F.lit(only).alias("shown"), F.lit(page).cast("long").alias("page"), "game_id")
        for only in FILTERS
        for page in PAGES
    ]
    return reduce(lambda a, b: a.union(b), made)


_CHOSEN = {"all": "TRUE", "correct": "model_was_right", "missed": "NOT model_was_right", "playoffs": "game_type = 3"}
_PAGES_SQL = ", ".join(f"(CAST({p} AS BIGINT))" for p in PAGES)
SQL_FILTERS = with_views(
    "preds_v",
    f"""{GRADED}, f AS ({" UNION ALL ".join(f"SELECT '{n}' AS shown, game_id, game_date FROM graded WHERE {c}" for n, c in _CHOSEN.items())}),
placed AS (SELECT *, row_number() OVER (PARTITION BY shown ORDER BY game_date DESC, game_id DESC) AS r, COUNT(*) OVER (PARTITION BY shown) AS n FROM f)
SELECT shown, page, game_id FROM placed, (VALUES {_PAGES_SQL}) p(page) WHERE (r - 1) // {board.PAGE_SIZE} = least(page, (n + {board.PAGE_SIZE - 1}) // {board.PAGE_SIZE}) - 1""",
)

REVIEWS = (
    {"month": "1998-05"}, {"team": 7}, {"outcome": "missed"}, {"month": "1998-05", "team": 7}, {"team": 7, "outcome": "correct"},
    {"month": "1999-11", "team": 7, "outcome": "missed"}, {"month": "1900-01"},
)


def review_filters(spark, folder):
    """Games and accuracy that each combination of month, team and outcome leaves; none for an empty one."""
    preds = standin.predictions(spark, folder)
    right = F.col("model_was_right").cast("int")
    made = [
        board.season_review(preds, **how).agg(
            F.lit(i).cast("long").alias("review"), F.count(F.lit(1)).alias("games"), (F.rint(100 * F.avg(right) * 10) / 10).alias("accuracy")
        )
        for i, how in enumerate(REVIEWS)
    ]
    return reduce(lambda a, b: a.union(b), made)


def _review_where(how: dict) -> str:
    tests = {
        "month": lambda v: f"strftime(game_date, '%Y-%m') = '{v}'", "team": lambda v: f"(home_team = {v} OR away_team = {v})",
        "outcome": lambda v: f"model_was_right = {v == 'correct'}",
    }
    return " AND ".join(tests[k](v) for k, v in how.items())


SQL_REVIEWS = with_views(
    "preds_v",
    f"{GRADED} " + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS review, COUNT(*) AS games, {rnd('100 * avg(CAST(model_was_right AS INT))', 1)} AS accuracy FROM graded WHERE {_review_where(how)}"
        for i, how in enumerate(REVIEWS)
    ),
)

# ---- predictions beside games and data set -----------------------------------------------------------------------


def _published(spark, folder):
    """Predictions alone: ids and probabilities, among them some of games that are in no table."""
    orders = standin.table(spark, folder, "orders").select(F.col("o_orderkey").alias("game_id"))
    of = orders.union(orders.select(-F.col("game_id")))
    return of.select("game_id", (((F.col("game_id") * 7919) % 1000 + F.lit(0.5)) / 1000).alias("p_home"))


def predictions_with_games(spark, folder):
    """Every published prediction with its game's date, state and teams; those of unknown games keep nulls."""
    games = standin.games(spark, folder).select("game_id", F.col("game_date").cast("string").alias("game_date"), "game_state", "home_team", "away_team")
    return board.with_games(_published(spark, folder), games)


_PUBLISHED = "p AS (SELECT g AS game_id, ((g * 7919) % 1000 + 0.5::DOUBLE) / 1000 AS p_home FROM (SELECT o_orderkey AS g FROM orders UNION ALL SELECT -o_orderkey FROM orders) o)"
SQL_PRED_GAMES = with_views(
    "games_v",
    f"{_PUBLISHED} SELECT p.game_id, p_home, CAST(game_date AS VARCHAR) AS game_date, game_state, home_team, away_team FROM p LEFT JOIN games_v USING (game_id)",
)


def history_with_dataset(spark, folder):
    """Graded history beside the row of the data set it was predicted from; games without such a row are left out."""
    preds = standin.predictions(spark, folder)
    data = ratings.season_game_index(history.eligible(standin.games(spark, folder), (2,)).select("game_id", "season", "game_date"))
    made = board.history_rows(board.graded(preds), data.select("game_id", "season_game_index"))
    return made.select("game_id", "season_game_index", "home_win_prob", "model_was_right")


SQL_HISTORY = with_views(
    "preds_v",
    f"""{GRADED}, d AS (SELECT game_id, row_number() OVER (PARTITION BY season ORDER BY game_date, game_id) - 1 AS season_game_index FROM games_v WHERE game_state IN ('OFF', 'FINAL') AND game_type = 2)
SELECT game_id, season_game_index, home_win_prob, model_was_right FROM graded JOIN d USING (game_id)""",
)

# ---- serving rows ------------------------------------------------------------------------------------------------

CARRIED = ("shots_avg", "hits_avg")
DIFFS = tuple(f"{c}_diff" for c in (*SERVED, *CARRIED))


def _carried(spark, folder):
    """Means of the team's newest season with box scores: what only the full data set knows."""
    done = history.team_games(history.eligible(standin.games(spark, folder))).select("game_id", "is_home", "team", "season")
    boxes = standin.box_scores(spark, folder).select("game_id", "is_home", "shots_for", "hits")
    per = done.join(boxes, ["game_id", "is_home"]).groupBy("team", "season").agg(
        (F.sum("shots_for") / F.count(F.lit(1))).alias("shots_avg"), (F.sum("hits") / F.count(F.lit(1))).alias("hits_avg")
    )
    newest = per.groupBy("team").agg(F.max_by(F.struct(*CARRIED), "season").alias("c"))
    return newest.select("team", "c.*")


def upcoming_differences(spark, folder):
    """Carried-forward features of both sides of the games to come, and all differences the row allows."""
    games = standin.games(spark, folder)
    asked = games.filter(~contest.is_completed(F.col("game_state")))
    rows = serving.upcoming_rows(games, asked, ratings.team_states(history.eligible(games)), _carried(spark, folder))
    rows = serving.inferred_differences(rows, list(DIFFS))
    made = [(F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in (*[f"{s}_{c}" for s in ("home", "away") for c in CARRIED], *DIFFS)]
    return rows.select("game_id", *made)


_CARRIED_SQL = """c AS (SELECT team, season, CAST(SUM(shots_for) AS DOUBLE) / COUNT(*) AS shots_avg, CAST(SUM(hits) AS DOUBLE) / COUNT(*) AS hits_avg
  FROM (SELECT game_id, season, home_team AS team, 1 AS is_home FROM games_v WHERE game_state = 'OFF' UNION ALL SELECT game_id, season, away_team, 0 FROM games_v WHERE game_state = 'OFF') s
  JOIN box_v USING (game_id, is_home) GROUP BY team, season QUALIFY row_number() OVER (PARTITION BY team ORDER BY season DESC) = 1)"""
SQL_UPCOMING_DIFFS = with_views(
    "games_v box_v",
    f"{_CARRIED_SQL}, up AS ({SQL_UPCOMING}) SELECT up.game_id, "
    + ", ".join(f"{rnd(f'{a}.{c}', 6)} AS {s}_{c}" for s, a in (("home", "ch"), ("away", "ca")) for c in CARRIED) + ", "
    + ", ".join(f"{rnd(f'up.home_{c} - up.away_{c}', 6)} AS {c}_diff" for c in SERVED) + ", "
    + ", ".join(f"{rnd(f'ch.{c} - ca.{c}', 6)} AS {c}_diff" for c in CARRIED)
    + " FROM up JOIN games_v g ON g.game_id = up.game_id LEFT JOIN c ch ON ch.team = g.home_team LEFT JOIN c ca ON ca.team = g.away_team",
)


def skipped_guests(spark, folder):
    """Games to come against guests from outside the pools: those with a side that has no rating are reported, the others get one."""
    games = standin.games(spark, folder)
    # guests carry numbers above those of the pools' teams for half of the home sides
    asked = games.filter(~contest.is_completed(F.col("game_state"))).withColumn("away_team", F.col("home_team") + 12)
    states = ratings.team_states(history.eligible(games))
    left = serving.skipped(asked, states).select("game_id", F.lit(True).alias("skipped"))
    return left.union(serving.rated(asked, states).select("game_id", F.lit(False)))


SQL_SKIPPED = with_views(
    "games_v",
    """t AS (SELECT home_team AS team FROM games_v WHERE game_state = 'OFF' UNION SELECT away_team FROM games_v WHERE game_state = 'OFF')
SELECT game_id, home_team NOT IN (SELECT team FROM t) OR home_team + 12 NOT IN (SELECT team FROM t) AS skipped FROM games_v WHERE game_state = 'FUT'""",
)

# ---- settings, days, columns -------------------------------------------------------------------------------------


def baseline_seasons(spark, folder):
    """The season the monitoring starts from: the stored setting, or the first final season where that is absent or unreadable."""
    preds = standin.predictions(spark, folder)
    # a table of settings as a delivery leaves it: the newest season that ended, and a text that is no number
    done = preds.filter(contest.is_completed(F.col("game_state")))
    settings = done.agg(F.max("season").alias("s")).select(
        F.explode(F.create_map(F.lit("baseline"), F.col("s").cast("string"), F.lit("broken"), F.lit("n/a"))).alias("key", "value")
    )
    made = [preds.agg(F.lit(k).alias("setting"), scores.baseline_season(preds, settings, k).alias("season")) for k in ("baseline", "broken", "absent")]
    return reduce(lambda a, b: a.union(b), made)


SQL_BASELINES = with_views(
    "preds_v",
    """d AS (SELECT MIN(season) AS first, MAX(season) AS last FROM preds_v WHERE game_state IN ('OFF', 'FINAL'))
SELECT 'baseline' AS setting, last AS season FROM d UNION ALL SELECT 'broken', first FROM d UNION ALL SELECT 'absent', first FROM d""",
)


def games_per_day(spark, folder):
    """Every day from a season's first game to its last with the games played on it, days without any included."""
    games = standin.games(spark, folder)
    played = games.groupBy("season", "game_date").agg(F.count(F.lit(1)).alias("games"))
    span = played.groupBy("season").agg(F.min("game_date").alias("a"), F.max("game_date").alias("b"))
    days = span.select("season", F.explode(calendar.date_range(F.col("a"), F.col("b"))).alias("game_date"))
    joined = days.join(played, ["season", "game_date"], "left")
    return joined.select("season", F.col("game_date").cast("string").alias("day"), F.coalesce("games", F.lit(0)).cast("long").alias("games"))


SQL_DAYS = with_views(
    "games_v",
    """s AS (SELECT season, MIN(game_date) AS a, MAX(game_date) AS b FROM games_v GROUP BY season),
d AS (SELECT season, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT d.season, CAST(day AS VARCHAR) AS day, COUNT(game_id) AS games FROM d LEFT JOIN games_v g ON g.season = d.season AND g.game_date = d.day GROUP BY 1, 2""",
)

WANTED = ("doc_id", "text", "lang", "source", "n_chars", "published_on")


def column_report(spark, folder):
    """Wanted columns of the documents: there or not, and in how many rows null."""
    return quality.column_report(standin.table(spark, folder, "documents"), WANTED)


SQL_COLUMNS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, TRUE AS present, COUNT(*) - COUNT({c}) AS nulls FROM documents" for c in WANTED[:-1]
) + f" UNION ALL SELECT '{WANTED[-1]}', FALSE, NULL"

QUERIES = {
    "result_filters": (result_filters, SQL_FILTERS),
    "review_filters": (review_filters, SQL_REVIEWS),
    "predictions_with_games": (predictions_with_games, SQL_PRED_GAMES),
    "history_with_dataset": (history_with_dataset, SQL_HISTORY),
    "upcoming_differences": (upcoming_differences, SQL_UPCOMING_DIFFS),
    "skipped_guests": (skipped_guests, SQL_SKIPPED),
    "baseline_seasons": (baseline_seasons, SQL_BASELINES),
    "games_per_day": (games_per_day, SQL_DAYS),
    "column_report": (column_report, SQL_COLUMNS),
}
