"""Registered queries over stored tables: guarded merges, dynamic artefacts, mergeable sketches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import contest
from ..operators import sketches, stored
from ..session import materialise, scratch_path
from ..sources import artefacts, documents, landing, standin
from .views_sql import with_views

# ---- guarded merges ----------------------------------------------------------------------------------------------

# the day the stored table was written, and the day from which on the delivery holds all games
WRITTEN, DELIVERED = "2000-09-01", "2000-03-01"
STORED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("season", "game_id")]
    + [T.StructField("prob", T.DoubleType()), T.StructField("status", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("home_score", "away_score", "winner")]
)
KEYS = ("season", "game_id")


def _rows(spark, folder, final):
    preds = standin.predictions(spark, folder)
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).otherwise(F.col("away_team"))
    return preds.select(
        "season", "game_id", "game_date", F.col("p_home").alias("prob"), F.when(final, "final").otherwise("upcoming").alias("status"),
        *[F.when(final, c).alias(n) for n, c in (("home_score", F.col("home_score")), ("away_score", F.col("away_score")), ("winner", winner))],
    )


def _write_table(spark, folder):
    """A stored table of the games dated before 2001, final where they were played by the day of writing."""
    path = scratch_path(spark, "results")
    day = lambda d: F.lit(d).cast("date")
    old = _rows(spark, folder, F.col("game_date") < day(WRITTEN)).filter(F.col("game_date") < day("2001-01-01"))
    landing.save_table(old, path, STORED, ("season",))
    return path


def _delivery(spark, folder):
    final = contest.is_completed(F.col("game_state"))
    return _rows(spark, folder, final).filter(F.col("game_date") >= F.lit(DELIVERED).cast("date"))


def _merge(spark, folder, path):
    return stored.merge_into(
        spark, path, STORED, _delivery(spark, folder), KEYS, "season", ("status", "home_score", "away_score", "winner"),
        guard=F.col("status") != "final",
    )


def merge_stored_results(spark, folder):
    """The stored table after a delivery: games not final take their result, unknown games are added."""
    path = _write_table(spark, folder)
    _merge(spark, folder, path)
    return landing.load_table(spark, path, STORED)


_SQL_STORED = f"""w AS (SELECT *, CASE WHEN home_score > away_score THEN home_team ELSE away_team END AS win FROM preds_v),
old AS (SELECT season, game_id, p_home AS prob, game_date < DATE '{WRITTEN}' AS done, home_score, away_score, win FROM w WHERE game_date < DATE '2001-01-01'),
del AS (SELECT season, game_id, p_home AS prob, game_state = 'OFF' AS done, home_score, away_score, win FROM w WHERE game_date >= DATE '{DELIVERED}'),
j AS (SELECT COALESCE(o.season, d.season) AS season, COALESCE(o.game_id, d.game_id) AS game_id, COALESCE(o.prob, d.prob) AS prob,
  COALESCE(o.done, FALSE) OR COALESCE(d.done, FALSE) AS done, COALESCE(o.home_score, d.home_score) AS hs, COALESCE(o.away_score, d.away_score) AS aws,
  COALESCE(o.win, d.win) AS win, o.game_id IS NULL AS added, o.game_id IS NOT NULL AND NOT o.done AND COALESCE(d.done, FALSE) AS updated
  FROM old o FULL OUTER JOIN del d ON o.season = d.season AND o.game_id = d.game_id)"""
SQL_MERGED = with_views(
    "preds_v",
    _SQL_STORED + """ SELECT season, game_id, prob, CASE WHEN done THEN 'final' ELSE 'upcoming' END AS status, CASE WHEN done THEN hs END AS home_score,
 CASE WHEN done THEN aws END AS away_score, CASE WHEN done THEN win END AS winner FROM j""",
)


def merge_touched_seasons(spark, folder):
    """Per season: rows, whether its files are other ones after the delivery, and after the same delivery once more."""
    path = _write_table(spark, folder)
    look = lambda: materialise(stored.partition_files(spark, path, STORED, "season"), "files")
    before = look()
    _merge(spark, folder, path)
    once = look()
    _merge(spark, folder, path)
    twice = look()
    b, t = (df.select("season", F.col("digest").alias(n)) for df, n in ((before, "b"), (twice, "t")))
    joined = once.join(b, "season", "left").join(t, "season", "left")
    return joined.select(
        "season", "rows", (~F.col("digest").eqNullSafe(F.col("b"))).alias("rewritten"), (~F.col("digest").eqNullSafe(F.col("t"))).alias("rewritten_again")
    )


SQL_TOUCHED = with_views(
    "preds_v",
    _SQL_STORED + " SELECT season, COUNT(*) AS rows, bool_or(added OR updated) AS rewritten, FALSE AS rewritten_again FROM j GROUP BY season",
)

# ---- artefacts whose fields are not known beforehand ---------------------------------------------------------------


def flatten_shifts(spark, folder):
    """Shift entries of every game with whatever fields their documents have."""
    made = artefacts.shift_table(documents.shift_charts(spark, folder))
    return made.withColumn("startTime", F.col("startTime").cast("double"))


SQL_SHIFTS = with_views(
    "games_v",
    """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, l_partkey AS "playerId", g.game_id, g.season,
 CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS BIGINT) END AS duration, CASE WHEN l_returnflag = 'R' THEN CAST(l_linestatus AS VARCHAR) END AS "eventDescription",
 CASE WHEN l_orderkey % 7 = 0 THEN CAST(l_suppkey AS DOUBLE) / 4 ELSE CAST(l_suppkey AS DOUBLE) END AS "startTime"
 FROM lineitem JOIN games_v g ON g.game_id = l_orderkey""",
)


def flatten_season_series(spark, folder):
    """Meetings listed in the series documents of the games, and one row for each document's opaque information."""
    return artefacts.series_table(documents.series_documents(spark, folder))


SQL_SERIES = with_views(
    "games_v",
    """m AS (SELECT game_id, season, pool, home_team, away_team, home_score, away_score, game_state, CAST(CAST(game_date AS DATE) AS VARCHAR) AS d FROM games_v),
docs AS (SELECT least(home_team, away_team) AS a, greatest(home_team, away_team) AS b, season, game_id // 64 AS part, MIN(game_id) AS doc, COUNT(*) AS n FROM m GROUP BY 1, 2, 3, 4)
SELECT doc AS game_id, m.season, m.game_id AS matchup_game_id, d AS matchup_game_date, 'T' || CAST(away_team AS VARCHAR) AS away_team, 'T' || CAST(home_team AS VARCHAR) AS home_team,
 CASE WHEN game_state = 'OFF' THEN away_score END AS away_score, CASE WHEN game_state = 'OFF' THEN home_score END AS home_score, game_state, NULL AS game_info
 FROM m JOIN docs ON docs.season = m.season AND part = m.game_id // 64 AND least(home_team, away_team) = a AND greatest(home_team, away_team) = b
UNION ALL SELECT doc, season, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{"meetings":' || CAST(n AS VARCHAR) || '}' FROM docs WHERE doc % 2 = 0""",
)

# ---- sketches ------------------------------------------------------------------------------------------------------


def _day_counts(spark, folder):
    return standin.play_events(spark, folder).groupBy(F.col("ts").cast("date").alias("day"), "game_id").agg(F.count(F.lit(1)).alias("n"))


def sketch_rollup(spark, folder):
    """Per range of days: exact counts, and whether those merged from stored daily sketches keep their stated error."""
    counts = materialise(_day_counts(spark, folder), "day-counts")
    daily = materialise(sketches.daily_sketches(counts, "day", "game_id", "n"), "sketches")
    spans = [(name, F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date"))) for name, a, b in SPANS]
    merged = sketches.merged(_ranges(daily, spans), "span")
    exact = _ranges(counts, spans).groupBy("span").agg(F.count_distinct("game_id").alias("games"), F.sum("n").alias("events"), F.count(F.lit(1)).alias("game_days"))
    return sketches.within_error(merged, exact, _ranges(counts, spans), "span")


# ranges of days that overlap: each is merged from the same daily sketches
SPANS = (("all", "1900-01-01", "2999-12-31"), ("early", "1900-01-01", "2024-01-10"), ("middle", "2024-01-08", "2024-01-20"), ("late", "2024-01-15", "2999-12-31"))


def _ranges(rows, spans):
    named = F.array_compact(F.array(*[F.when(inside, name) for name, inside in spans]))
    return rows.withColumn("span", F.explode(named))


_SPAN_SQL = " UNION ALL ".join(f"SELECT '{n}' AS span, DATE '{a}' AS a, DATE '{b}' AS b" for n, a, b in SPANS)
SQL_SKETCH = f"""WITH spans AS ({_SPAN_SQL}), c AS (SELECT CAST(ts AS DATE) AS day, user_id AS game_id, COUNT(*) AS n FROM events GROUP BY 1, 2)
SELECT span, COUNT(DISTINCT game_id) AS games, CAST(SUM(n) AS BIGINT) AS events, COUNT(*) AS game_days, TRUE AS distinct_ok, TRUE AS median_ok, TRUE AS upper_ok
FROM c JOIN spans ON day BETWEEN a AND b GROUP BY span"""

QUERIES = {
    "merge_stored_results": (merge_stored_results, SQL_MERGED),
    "merge_touched_seasons": (merge_touched_seasons, SQL_TOUCHED),
    "flatten_shifts": (flatten_shifts, SQL_SHIFTS),
    "flatten_season_series": (flatten_season_series, SQL_SERIES),
    "sketch_rollup": (sketch_rollup, SQL_SKETCH),
}
