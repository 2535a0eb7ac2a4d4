"""Registered queries for ranges, tails and id predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, contest
from ..operators import board, slices
from ..sources import standin
from .views_sql import with_views

SPAN = (19971998, 19992000)
LAST = 200


def recent_games(spark, folder):
    """The last games of a range of seasons."""
    made = slices.recent_games(standin.games(spark, folder), *SPAN, LAST)
    return made.select("game_id", "season", F.col("game_date").cast("string").alias("game_date"))


SQL_RECENT = with_views(
    "games_v",
    f"SELECT game_id, season, CAST(game_date AS VARCHAR) AS game_date FROM games_v WHERE season BETWEEN {SPAN[0]} AND {SPAN[1]} ORDER BY games_v.game_date DESC, game_id DESC LIMIT {LAST}",
)


def season_span(spark, folder):
    """Games inside a range of seasons, open at either end, per season."""
    s = F.col("season")
    kinds = {"closed": SPAN, "from": (SPAN[0], None), "until": (None, SPAN[1]), "all": (None, None)}
    return standin.games(spark, folder).groupBy("season").agg(
        *[F.sum(slices.season_range(s, *span).cast("long")).alias(name) for name, span in kinds.items()]
    )


SQL_SPAN = with_views(
    "games_v",
    f"""SELECT season, COUNT(*) FILTER (WHERE season BETWEEN {SPAN[0]} AND {SPAN[1]}) AS closed, COUNT(*) FILTER (WHERE season >= {SPAN[0]}) AS "from",
 COUNT(*) FILTER (WHERE season <= {SPAN[1]}) AS until, COUNT(*) AS "all" FROM games_v GROUP BY season""",
)


def regular_ids(spark, folder):
    """Games whose ten-digit id says regular season, per season."""
    season, kind = F.floor(F.col("season") / 10000).cast("string"), F.col("game_type").cast("string")
    ten = F.concat(season, F.lit("0"), kind, F.lpad((F.col("game_id") % 10000).cast("string"), 4, "0"))
    games = standin.games(spark, folder).select("season", ten.alias("ten"))
    return games.filter(slices.id_kind(F.col("ten")) == "02").groupBy("season").agg(F.count(F.lit(1)).alias("games"), F.min("ten").alias("first_id"))


SQL_REGULAR = with_views(
    "games_v",
    """t AS (SELECT season, CAST(season // 10000 AS VARCHAR) || '0' || CAST(game_type AS VARCHAR) || lpad(CAST(game_id % 10000 AS VARCHAR), 4, '0') AS ten FROM games_v)
SELECT season, COUNT(*) AS games, MIN(ten) AS first_id FROM t WHERE substr(ten, 5, 2) = '02' GROUP BY season""",
)


def review_tail(spark, folder):
    """The newest reviewed games of a team that the model got right, by month filter and outcome."""
    review = board.season_review(standin.predictions(spark, folder), team=3, outcome="correct")
    made = slices.review_tail(review, 40)
    return made.select(F.col("place").cast("long").alias("place"), "game_id", F.col("game_date").cast("string").alias("game_date"))


SQL_REVIEW = with_views(
    "preds_v",
    """g AS (SELECT game_id, game_date, (p_home * 100 >= 50) = (home_score > away_score) AS ok FROM preds_v WHERE game_state = 'OFF' AND (home_team = 3 OR away_team = 3))
SELECT row_number() OVER (ORDER BY game_date DESC, game_id DESC) - 1 AS place, game_id, CAST(game_date AS VARCHAR) AS game_date FROM g WHERE ok
ORDER BY g.game_date DESC, game_id DESC LIMIT 40""",
)


def season_id_set(spark, folder):
    """Seasons a refresh has to fetch: the one last saved, the one of its day and the one a month later."""
    games = standin.games(spark, folder)
    saved = F.when(contest.is_completed(F.col("game_state")), F.col("season"))
    asked = slices.season_id_set(saved, calendar.season_of(F.col("game_date")), calendar.season_of(F.date_add("game_date", 31)))
    return games.groupBy(F.array_join(asked.cast("array<string>"), ",").alias("seasons")).agg(F.count(F.lit(1)).alias("games"))


SQL_SET = with_views(
    "games_v",
    """h AS (SELECT *, game_date + INTERVAL 31 DAY AS later FROM games_v),
s AS (SELECT season, CAST(CASE WHEN month(later) >= 8 THEN year(later) * 10000 + year(later) + 1 ELSE (year(later) - 1) * 10000 + year(later) END AS BIGINT) AS horizon FROM h)
SELECT CASE WHEN season = horizon THEN CAST(season AS VARCHAR) ELSE CAST(season AS VARCHAR) || ',' || CAST(horizon AS VARCHAR) END AS seasons, COUNT(*) AS games FROM s GROUP BY 1""",
)

QUERIES = {
    "recent_games": (recent_games, SQL_RECENT),
    "season_span": (season_span, SQL_SPAN),
    "regular_ids": (regular_ids, SQL_REGULAR),
    "review_tail": (review_tail, SQL_REVIEW),
    "season_id_set": (season_id_set, SQL_SET),
}
