"""Registered queries about picks, boards, pages, stores and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, contest
from ..functions.numbers import signed
from ..operators import board, boxes, history, quality, store
from ..sources import standin
from .catalog_form import HIST
from .catalog_scores import rnd
from .views_sql import with_views

DONE = "done AS (SELECT * FROM games_v WHERE game_state IN ('OFF', 'FINAL') AND game_type IN (2, 3))"


def _text_date(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def _results(spark, folder):
    games = standin.games(spark, folder)
    home = F.when(F.col("home_score") > F.col("away_score"), "home").otherwise("away")
    return games.select("game_id", F.when(contest.is_completed(F.col("game_state")), home).alias("winner"))


def _open_picks(spark, folder):
    none = F.lit(None).cast("long")
    return standin.picks(spark, folder).withColumns({"is_correct": none, "points": none})


RESULTS = """results_v AS (SELECT game_id, CASE WHEN game_state IN ('OFF','FINAL') THEN CASE WHEN home_score > away_score THEN 'home' ELSE 'away' END END AS winner FROM games_v),
settled AS (SELECT p.user_id, p.game_id, p.pick, CASE WHEN winner IS NOT NULL THEN CAST(pick = winner AS BIGINT) END AS is_correct,
  CASE WHEN winner IS NOT NULL THEN CAST(CASE WHEN pick = winner THEN 100 ELSE 10 END AS BIGINT) END AS points FROM picks_v p JOIN results_v USING (game_id))"""


def settle_picks(spark, folder):
    made = board.settle(_open_picks(spark, folder), _results(spark, folder))
    return made.select("user_id", "game_id", "pick", "is_correct", "points")


SQL_SETTLE = with_views("games_v picks_v", RESULTS + " SELECT * FROM settled")


def member_leaderboard(spark, folder):
    made = board.leaderboard(board.settle(_open_picks(spark, folder), _results(spark, folder)))
    return made.select("rank", "user_id", "accuracy", "streak", "points", "total_picks", "correct_picks")


_BOARD = """
last_miss AS (SELECT user_id, MAX(game_id) AS miss FROM settled WHERE is_correct = 0 GROUP BY user_id),
streaks AS (SELECT s.user_id, CAST(SUM(CASE WHEN m.miss IS NULL OR s.game_id > m.miss THEN 1 ELSE 0 END) AS BIGINT) AS streak
  FROM settled s LEFT JOIN last_miss m USING (user_id) WHERE is_correct IS NOT NULL GROUP BY s.user_id),
sums AS (SELECT user_id, COUNT(*) AS total_picks, CAST(SUM(is_correct) AS BIGINT) AS correct_picks, CAST(SUM(points) AS BIGINT) AS points
  FROM settled WHERE is_correct IS NOT NULL GROUP BY user_id)
SELECT row_number() OVER (ORDER BY points DESC, correct_picks DESC, user_id) AS rank, user_id,
  round_even((CAST(correct_picks AS DOUBLE) / total_picks * 100) * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS accuracy, streak, points, total_picks, correct_picks
FROM sums JOIN streaks USING (user_id)"""
SQL_LEADERBOARD = with_views("games_v picks_v", RESULTS + "," + _BOARD)


def current_streak(spark, folder):
    settled = board.settle(_open_picks(spark, folder), _results(spark, folder)).filter(F.col("is_correct").isNotNull())
    return board.current_streaks(settled)


SQL_STREAK = with_views(
    "games_v picks_v",
    RESULTS + """, ordered AS (SELECT user_id, SUM(1 - is_correct) OVER (PARTITION BY user_id ORDER BY game_id DESC) AS misses FROM settled WHERE is_correct IS NOT NULL)
SELECT user_id, CAST(COUNT(*) FILTER (WHERE misses = 0) AS BIGINT) AS streak FROM ordered GROUP BY user_id""",
)


def pending_picks(spark, folder):
    settled = board.settle(_open_picks(spark, folder), _results(spark, folder))
    return settled.filter(F.col("is_correct").isNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("pending"))


SQL_PENDING = with_views("games_v picks_v", RESULTS + " SELECT user_id, COUNT(*) AS pending FROM settled WHERE is_correct IS NULL GROUP BY user_id")


def strategy_backtest(spark, folder):
    preds = standin.predictions(spark, folder)
    playoffs = preds.filter(contest.is_completed(F.col("game_state")) & (F.col("game_type") == contest.PLAYOFF))
    runs = board.better_run(history.team_games(playoffs))
    settled = board.settle(board.strategy_picks(playoffs, runs), _results(spark, folder))
    made = board.leaderboard(settled)
    return made.select("rank", F.col("user_id").alias("strategy"), "accuracy", "streak", "points", "total_picks", "correct_picks")


SQL_STRATEGY = with_views(
    "preds_v",
    HIST.format(types="(3)").replace("ORDER BY game_date, game_id) AS rn", "ORDER BY game_date, game_id) AS all_rn, row_number() OVER (PARTITION BY season, team ORDER BY game_date, game_id) AS rn") + """,
runs AS (SELECT game_id, is_home, COALESCE(SUM(win) OVER (PARTITION BY season, team ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS run FROM hist),
g AS (SELECT p.*, h.run AS hr, a.run AS ar, CASE WHEN p.home_score > p.away_score THEN 'home' ELSE 'away' END AS winner
  FROM preds_v p JOIN runs h ON h.game_id = p.game_id AND h.is_home = 1 JOIN runs a ON a.game_id = p.game_id AND a.is_home = 0),
c AS (SELECT game_id, winner, 'ModelFollower' AS user_id, CASE WHEN p_home >= 0.5 THEN 'home' ELSE 'away' END AS pick FROM g
 UNION ALL SELECT game_id, winner, 'HomeIceFan', 'home' FROM g UNION ALL SELECT game_id, winner, 'RoadWarrior', 'away' FROM g
 UNION ALL SELECT game_id, winner, 'FormChaser', CASE WHEN ar > hr THEN 'away' ELSE 'home' END FROM g
 UNION ALL SELECT game_id, winner, 'Contrarian', CASE WHEN p_home >= 0.5 THEN 'away' ELSE 'home' END FROM g),
settled AS (SELECT user_id, game_id, CAST(pick = winner AS BIGINT) AS is_correct, CASE WHEN pick = winner THEN 100 ELSE 10 END AS points FROM c),""" + _BOARD.replace(
        "SELECT row_number() OVER (ORDER BY points DESC, correct_picks DESC, user_id) AS rank, user_id,",
        "SELECT row_number() OVER (ORDER BY points DESC, correct_picks DESC, user_id) AS rank, user_id AS strategy,",
    ),
)


def latest_picks(spark, folder):
    """A pick log in which every fifth pick was changed a day later; the last write of a (member, game) counts."""
    first = standin.picks(spark, folder)
    flipped = F.when(F.col("pick") == "home", "away").otherwise("home")
    second = first.filter(F.col("game_id") % 5 == 0).withColumns({"pick": flipped, "made_on": F.date_add("made_on", 1)})
    return _text_date(board.latest_picks(first.unionByName(second), ["made_on"]), "made_on")


SQL_LATEST = with_views(
    "picks_v",
    """log AS (SELECT * FROM picks_v UNION ALL SELECT user_id, game_id, made_on + 1, CASE WHEN pick = 'home' THEN 'away' ELSE 'home' END FROM picks_v WHERE game_id % 5 = 0)
SELECT user_id, game_id, CAST(CAST(MAX(made_on) AS DATE) AS VARCHAR) AS made_on, arg_max(pick, made_on) AS pick FROM log GROUP BY user_id, game_id""",
)


def results_page(spark, folder):
    return _text_date(board.results_page(standin.predictions(spark, folder), "correct", 2), "game_date")


GRADED = f"""graded AS (SELECT game_id, season, game_date, game_type, home_team, away_team, {rnd('100 * p_home', 3)} AS home_win_prob,
 {rnd('100 - ' + rnd('100 * p_home', 3), 3)} AS away_win_prob, CASE WHEN p_home >= 0.5 THEN home_team ELSE away_team END AS favourite,
 CASE WHEN home_score > away_score THEN home_team ELSE away_team END AS winner, (p_home >= 0.5) = (home_score > away_score) AS model_was_right
 FROM preds_v WHERE game_state IN ('OFF', 'FINAL'))"""
_COLS = "game_id, season, CAST(game_date AS VARCHAR) AS game_date, game_type, home_team, away_team, home_win_prob, away_win_prob, favourite, winner, model_was_right"
SQL_PAGE = with_views("preds_v", f"{GRADED} SELECT {_COLS} FROM graded WHERE model_was_right ORDER BY graded.game_date DESC, game_id DESC LIMIT 25 OFFSET 25")


def graded_results(spark, folder):
    return _text_date(board.graded(standin.predictions(spark, folder)), "game_date")


SQL_GRADED = with_views("preds_v", f"{GRADED} SELECT {_COLS} FROM graded")


def season_review(spark, folder):
    """Accuracy of the games of one team that the filter leaves, per month."""
    rows = board.season_review(standin.predictions(spark, folder), team=3)
    return rows.groupBy(calendar.month_key(F.col("game_date")).alias("month")).agg(
        F.count(F.lit(1)).alias("games"), (F.rint(100 * F.avg(F.col("model_was_right").cast("int")) * 10) / 10).alias("accuracy")
    )


SQL_REVIEW = with_views(
    "preds_v",
    f"""{GRADED} SELECT strftime(game_date, '%Y-%m') AS month, COUNT(*) AS games, {rnd('100 * avg(CAST(model_was_right AS INT))', 1)} AS accuracy
FROM graded WHERE home_team = 3 OR away_team = 3 GROUP BY 1""",
)


def last_five_form(spark, folder):
    rows = history.team_games(history.eligible(standin.games(spark, folder)))
    plain = board.last_form(rows, ["season", "team"])
    ot = board.last_form(rows, ["season", "team"], overtime=True).withColumnRenamed("form", "form_with_overtime")
    return plain.join(ot, ["season", "team"])


SQL_FORM = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + """,
l AS (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY game_date DESC, game_id DESC) AS r FROM hist)
SELECT season, team, string_agg(CASE WHEN win = 1 THEN 'W' ELSE 'L' END, ',' ORDER BY r DESC) AS form,
 string_agg(CASE WHEN win = 1 THEN 'W' WHEN last_period_type IN ('OT', 'SO') THEN 'O' ELSE 'L' END, ',' ORDER BY r DESC) AS form_with_overtime
FROM l WHERE r <= 5 GROUP BY season, team""",
)


def _comments(spark, folder):
    talk = standin.table(spark, folder, "conversations")
    return talk.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("comment_id"), "conv_id", "turn", "role",
        F.upper(F.substring("role", 1, 2)).alias("initials"), F.md5("text").alias("body_md5"),
    )


def _clicks(spark, folder):
    events = standin.table(spark, folder, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return events.select((F.col("user_id") * 100 + k % 6).alias("comment_id"), (F.floor("value") % 7).alias("member"))


CLICKS = """clicks AS (SELECT user_id * 100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 6 AS comment_id, CAST(floor(value) AS BIGINT) % 7 AS member FROM events),
liked AS (SELECT comment_id, member FROM clicks GROUP BY comment_id, member HAVING COUNT(*) % 2 = 1)"""


def comment_threads(spark, folder):
    return board.comment_threads(_comments(spark, folder), _clicks(spark, folder), 3)


SQL_COMMENTS = "WITH " + CLICKS + """
SELECT conv_id * 100 + turn AS comment_id, conv_id, turn, role, upper(substr(role, 1, 2)) AS initials, md5(text) AS body_md5,
 (SELECT COUNT(*) FROM liked WHERE liked.comment_id = conv_id * 100 + turn) AS likes,
 EXISTS (SELECT 1 FROM liked WHERE liked.comment_id = conv_id * 100 + turn AND member = 3) AS liked_by_me
FROM conversations"""


def like_toggle(spark, folder):
    return board.likes(_clicks(spark, folder))


SQL_LIKES = "WITH " + CLICKS + " SELECT * FROM liked"


def _team_stats(spark, folder, season):
    done = history.eligible(standin.games(spark, folder))
    box = boxes.with_opponent(
        standin.box_scores(spark, folder), {"powerplay_goals": "opp_pp_goals", "powerplay_opportunities": "opp_pp_opps"}
    )
    lines = history.team_games(done.filter(F.col("season") == season)).join(box, ["game_id", "is_home"])
    return boxes.team_season_stats(lines.withColumn("faceoff_win_pct", F.rint(F.col("faceoff_win_pct") * 1e4)))


STATS_SEASON = 20002001


def matchup_comparison(spark, folder):
    stats = _team_stats(spark, folder, STATS_SEASON).withColumn("faceoff_win", F.rint(F.col("faceoff_win") / 1e4 * 10) / 10)
    upcoming = standin.games(spark, folder).filter(~contest.is_completed(F.col("game_state"))).select("game_id", "home_team", "away_team")
    return board.matchup_rows(upcoming, stats)


def _compare_sql() -> str:
    from .catalog_form import SQL_TEAM_STATS

    stats = SQL_TEAM_STATS.replace("WHERE h.game_type = 2", f"WHERE h.game_type = 2 AND h.season = {STATS_SEASON}")
    head, body = stats.rsplit("\nSELECT h.season", 1)
    rows = []
    for c, label, big, unit, higher in board.COMPARED:
        text = lambda v: f"CASE WHEN {v} = floor({v}) THEN CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR) ELSE CAST({rnd(v, 2)} AS VARCHAR) END"
        width = lambda v: f"least(greatest(round_even({v} / {big}::DOUBLE * 100.0::DOUBLE, 0), 4.0::DOUBLE), 100.0::DOUBLE)"
        rows.append(
            f"SELECT game_id, '{label}' AS label, '{unit}' AS unit, h.{c} AS home_value, a.{c} AS away_value, {text(f'h.{c}')} AS home_text, {text(f'a.{c}')} AS away_text, "
            f"{width(f'h.{c}')} AS home_width, {width(f'a.{c}')} AS away_width, h.{c} {'>' if higher else '<'} a.{c} AS home_better "
            f"FROM up JOIN stats h ON h.team = up.home_team JOIN stats a ON a.team = up.away_team WHERE h.{c} IS NOT NULL AND a.{c} IS NOT NULL"
        )
    return head + ",\nstats AS (SELECT h.season" + body + "),\nup AS (SELECT * FROM games_v WHERE game_state = 'FUT')\n" + " UNION ALL ".join(rows)


SQL_COMPARE = _compare_sql()

SEASON = 20002001


def shown_season(spark, folder):
    return board.shown_season(standin.games(spark, folder), 20012002).unionByName(board.shown_season(standin.games(spark, folder), SEASON))


_SHOWN = "SELECT COUNT(*) AS played, CAST(CASE WHEN COUNT(*) >= 64 THEN {s} ELSE {s} - 10001 END AS BIGINT) AS shown_season FROM games_v WHERE game_state IN ('OFF','FINAL') AND season = {s} AND game_type = 2"
SQL_SHOWN = with_views("games_v", _SHOWN.format(s=20012002) + " UNION ALL " + _SHOWN.format(s=SEASON))


def featured_games(spark, folder):
    preds = standin.predictions(spark, folder).select("game_id", "game_date", "game_state", "game_type", "home_team", "away_team", "p_home")
    live_slate = board.featured(preds).withColumn("view", F.lit("in season"))
    no_slate = board.featured(preds.filter(contest.is_completed(F.col("game_state")))).withColumn("view", F.lit("between seasons"))
    return live_slate.unionByName(no_slate).select(
        "view", "offseason", "game_id", F.col("game_date").cast("string").alias("game_date"), "home_team", "away_team",
        contest.fair_odds(F.col("p_home"), 0.01).alias("home_odds"),
    )


_ODDS1 = "CAST(round_even(CASE WHEN p_home >= 0.5 THEN -100 * least(p_home, 0.99::DOUBLE) / (1 - least(p_home, 0.99::DOUBLE)) ELSE 100 * (1 - greatest(p_home, 0.01::DOUBLE)) / greatest(p_home, 0.01::DOUBLE) END, 0) AS BIGINT) AS home_odds"
SQL_FEATURED = with_views(
    "preds_v",
    f"""up AS (SELECT * FROM preds_v WHERE game_state = 'FUT' ORDER BY game_date, game_id LIMIT 4),
po AS (SELECT * FROM preds_v WHERE game_state = 'OFF' AND game_type = 3 ORDER BY game_date DESC, game_id DESC LIMIT 4)
SELECT 'in season' AS "view", false AS offseason, game_id, CAST(game_date AS VARCHAR) AS game_date, home_team, away_team, {_ODDS1} FROM up
UNION ALL SELECT 'between seasons', true, game_id, CAST(game_date AS VARCHAR), home_team, away_team, {_ODDS1} FROM po""",
)


def replay_choice(spark, folder):
    made = board.replay_choice(standin.games(spark, folder), standin.table(spark, folder, "events").select(F.col("user_id").alias("game_id")))
    return _text_date(made.select("game_id", "game_date", "home_team", "away_team", "home_score", "away_score", "close"), "game_date")


SQL_REPLAY = with_views(
    "games_v",
    """SELECT game_id, CAST(game_date AS VARCHAR) AS game_date, home_team, away_team, home_score, away_score, abs(home_score - away_score) <= 1 AS close
FROM games_v WHERE game_state = 'OFF' AND game_type = 3 AND EXISTS (SELECT 1 FROM events WHERE user_id = game_id)
ORDER BY abs(home_score - away_score) <= 1 DESC, games_v.game_date DESC, game_id DESC LIMIT 1""",
)


def pair_join_dedupe(spark, folder):
    games = standin.games(spark, folder)
    fixtures = games.filter(~contest.is_completed(F.col("game_state"))).select("game_id", "home_team", "away_team")
    preds = standin.predictions(spark, folder).select("home_team", "away_team", F.col("p_home").alias("p"), F.col("game_id").alias("pred_id"))
    return board.pair_join(preds, fixtures)


SQL_PAIR = with_views(
    "preds_v",
    """fan AS (SELECT f.game_id, f.home_team, f.away_team, p.p_home AS p, p.game_id AS pred_id FROM games_v f JOIN preds_v p USING (home_team, away_team) WHERE f.game_state = 'FUT')
SELECT * FROM fan QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY pred_id) = 1""",
)


def games_with_teams(spark, folder):
    """Games with both teams' rows attached; the team table has one row per nation."""
    games = standin.games(spark, folder)
    teams = standin.teams(spark, folder)
    for side in ("home", "away"):
        part = teams.select(F.col("team").alias(f"{side}_team"), F.col("name").alias(f"{side}_name"))
        games = games.join(part, f"{side}_team")
    return games.select("game_id", F.concat("away_name", F.lit(" @ "), "home_name").alias("label"))


SQL_GAMES_TEAMS = with_views(
    "games_v",
    "SELECT game_id, a.n_name || ' @ ' || h.n_name AS label FROM games_v JOIN nation h ON h.n_nationkey = home_team JOIN nation a ON a.n_nationkey = away_team",
)


# ---- stores ------------------------------------------------------------------------------------------------------


# the stored table was last written on this day; later games are new to it
STORED_UNTIL = "1999-06-30"


def _stored(spark, folder):
    """The games table as stored before a delivery: all games dated up to a day, with a first probability."""
    preds = standin.predictions(spark, folder).filter(F.col("game_date") <= F.lit(STORED_UNTIL).cast("date"))
    status = F.when(contest.is_completed(F.col("game_state")) & (F.col("game_id") % 3 != 0), "final").otherwise("upcoming")
    final = status == "final"
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).otherwise(F.col("away_team"))
    return preds.select(
        "game_id", "season", "home_team", "away_team", F.col("p_logit").alias("prob"), status.alias("status"),
        F.when(final, F.col("home_score")).alias("home_score"), F.when(final, F.col("away_score")).alias("away_score"),
        F.when(final, winner).alias("winner"),
    )


STORED = """stored AS (SELECT game_id, season, home_team, away_team, p_logit AS prob, CASE WHEN game_state = 'OFF' AND game_id % 3 <> 0 THEN 'final' ELSE 'upcoming' END AS status,
  CASE WHEN game_state = 'OFF' AND game_id % 3 <> 0 THEN home_score END AS home_score, CASE WHEN game_state = 'OFF' AND game_id % 3 <> 0 THEN away_score END AS away_score,
  CASE WHEN game_state = 'OFF' AND game_id % 3 <> 0 THEN CASE WHEN home_score > away_score THEN home_team ELSE away_team END END AS winner
  FROM preds_v WHERE game_date <= DATE '1999-06-30')"""


def upsert_upcoming(spark, folder):
    """New probabilities reach only games still upcoming; unknown games are added."""
    none = F.lit(None).cast("long")
    new = standin.predictions(spark, folder).select(
        "game_id", "season", "home_team", "away_team", F.col("p_home").alias("prob"), F.lit("upcoming").alias("status"),
        none.alias("home_score"), none.alias("away_score"), none.alias("winner"),
    )
    keep = ("season", "home_team", "away_team", "status", "home_score", "away_score", "winner")
    return store.upsert(_stored(spark, folder), new, ["game_id"], keep, F.col("status") == "upcoming")


SQL_UPSERT = with_views(
    "preds_v",
    f"""{STORED} SELECT n.game_id, n.season, n.home_team, n.away_team, CASE WHEN o.status = 'final' THEN o.prob ELSE n.p_home END AS prob,
 COALESCE(o.status, 'upcoming') AS status, o.home_score, o.away_score, o.winner FROM preds_v n LEFT JOIN stored o USING (game_id)""",
)


def apply_results(spark, folder):
    """Scores of finished games reach stored games that are not final yet; ``changed`` marks them."""
    games = standin.games(spark, folder).filter(contest.is_completed(F.col("game_state")))
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).otherwise(F.col("away_team"))
    new = games.select("game_id", "home_score", "away_score", winner.alias("winner"))
    sets = {"status": F.lit("final")} | {c: F.col(f"_n_{c}") for c in ("home_score", "away_score", "winner")}
    return store.update_where(_stored(spark, folder), new, ["game_id"], F.col("status") != "final", sets)


SQL_APPLY = with_views(
    "preds_v",
    f"""{STORED}, n AS (SELECT game_id, home_score, away_score, CASE WHEN home_score > away_score THEN home_team ELSE away_team END AS winner FROM preds_v WHERE game_state = 'OFF'),
j AS (SELECT o.*, n.home_score AS nh, n.away_score AS na, n.winner AS nw, n.game_id IS NOT NULL AND o.status <> 'final' AS changed FROM stored o LEFT JOIN n USING (game_id))
SELECT game_id, season, home_team, away_team, prob, CASE WHEN changed THEN 'final' ELSE status END AS status, CASE WHEN changed THEN nh ELSE home_score END AS home_score,
 CASE WHEN changed THEN na ELSE away_score END AS away_score, CASE WHEN changed THEN nw ELSE winner END AS winner, changed FROM j""",
)


def insert_if_absent(spark, folder):
    new = standin.predictions(spark, folder).filter(F.col("game_type") == 3).select(
        "game_id", "season", "home_team", "away_team", F.col("p_home").alias("prob"), F.lit("history").alias("status"),
        "home_score", "away_score", F.when(F.col("home_score") > F.col("away_score"), F.col("home_team")).otherwise(F.col("away_team")).alias("winner"),
    )
    return store.insert_absent(_stored(spark, folder), new, ["game_id"])


SQL_INSERT = with_views(
    "preds_v",
    f"""{STORED} SELECT * FROM stored UNION ALL SELECT game_id, season, home_team, away_team, p_home, 'history', home_score, away_score,
 CASE WHEN home_score > away_score THEN home_team ELSE away_team END FROM preds_v WHERE game_type = 3 AND game_id NOT IN (SELECT game_id FROM stored)""",
)


def upsert_teams(spark, folder):
    """Team rows are replaced except for their colour, which is set once."""
    # the stored directory starts five numbers later, so some teams are new, some known and some gone
    old = standin.teams(spark, folder).select((F.col("team") + 5).alias("team"), "name", F.lit("#old").alias("color"), F.lit(0).cast("long").alias("points"))
    settled = history.team_games(history.eligible(standin.games(spark, folder)))
    new = settled.groupBy("team").agg(F.sum("points").cast("long").alias("points")).select(
        "team", F.concat(F.lit("T"), F.col("team").cast("string")).alias("name"), F.lit("#new").alias("color"), "points"
    )
    return store.upsert(old, new, ["team"], keep=("color",))


SQL_TEAMS = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + """, n AS (SELECT team, 'T' || CAST(team AS VARCHAR) AS name, CAST(SUM(2 * win) AS BIGINT) AS points FROM hist GROUP BY team)
SELECT COALESCE(n.team, o.n_nationkey) AS team, COALESCE(n.name, o.n_name) AS name, CASE WHEN o.n_nationkey IS NULL THEN '#new' ELSE '#old' END AS color, COALESCE(n.points, 0) AS points
FROM (SELECT CAST(n_nationkey + 5 AS BIGINT) AS n_nationkey, n_name FROM nation) o FULL OUTER JOIN n ON n.team = o.n_nationkey""",
)


def metadata_upsert(spark, folder):
    """Key-value settings: counts of the current delivery replace the stored ones."""
    old = standin.teams(spark, folder).select(F.concat(F.lit("season_"), F.col("team") + 1990).alias("key"), F.lit("0").alias("value"))
    new = standin.games(spark, folder).groupBy(F.floor(F.col("season") / 10000).alias("y")).agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("season_"), F.col("y").cast("string")).alias("key"), F.col("n").cast("string").alias("value")
    )
    return store.upsert(old, new, ["key"])


SQL_META = with_views(
    "games_v",
    """n AS (SELECT 'season_' || CAST(season // 10000 AS VARCHAR) AS key, CAST(COUNT(*) AS VARCHAR) AS value FROM games_v GROUP BY season),
o AS (SELECT 'season_' || CAST(n_nationkey + 1990 AS VARCHAR) AS key, '0' AS value FROM nation)
SELECT COALESCE(n.key, o.key) AS key, COALESCE(n.value, o.value) AS value FROM o FULL OUTER JOIN n ON n.key = o.key""",
)


# ---- quality and small lists ---------------------------------------------------------------------------------------


def missing_artifacts(spark, folder):
    lines = standin.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("game_id"))
    return quality.missing_artifacts(standin.games(spark, folder), lines)


SQL_MISSING = with_views("games_v", "SELECT game_id, season FROM games_v WHERE game_state = 'OFF' AND game_id NOT IN (SELECT l_orderkey FROM lineitem)")


def dq_report(spark, folder):
    lines = standin.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("game_id"))
    plays = standin.table(spark, folder, "events").select(F.col("user_id").alias("game_id"))
    report = quality.quality_report(standin.games(spark, folder), lines, plays)
    line_dups = quality.duplicate_ids(
        standin.table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id")), "line_id"
    ).withColumnRenamed("duplicates", "duplicate_lines")
    return report.join(F.broadcast(line_dups))  # one row each


SQL_DQ = with_views(
    "games_v",
    """SELECT COUNT(*) FILTER (WHERE game_state = 'FUT') AS upcoming_games,
 COUNT(*) FILTER (WHERE game_state = 'OFF' AND game_id NOT IN (SELECT l_orderkey FROM lineitem)) AS missing_boxscores,
 COUNT(*) FILTER (WHERE game_state = 'OFF' AND game_id NOT IN (SELECT user_id FROM events)) AS missing_plays,
 COUNT(*) - COUNT(DISTINCT game_id) AS duplicate_games,
 (SELECT COUNT(*) - COUNT(DISTINCT l_orderkey * 10 + l_linenumber) FROM lineitem) AS duplicate_lines FROM games_v""",
)


def leakage_check(spark, folder):
    """No feature row may have a source on or after its own date."""
    done = history.eligible(standin.games(spark, folder))
    days = history.team_days(history.team_games(done), None, (*history.SCORE_METRICS, "game_date"))
    newest = F.array_max(F.transform("recent", lambda g: g["game_date"]))
    rows = days.rows.select("game_date", F.greatest("last_date", newest).alias("source_date"))
    return quality.leakage(rows)


SQL_LEAK = with_views(
    "games_v",
    DONE + " SELECT COUNT(*) AS checked, CAST(0 AS BIGINT) AS leaks FROM (SELECT home_team, season, game_date FROM done UNION SELECT away_team, season, game_date FROM done) t",
)


# the day up to which results are published; what is played later is live
PUBLISHED = "1999-12-31"


def season_disjoint(spark, folder):
    """Seasons with published games, and how many of them also have live ones (a season that runs over the day has both)."""
    games = standin.games(spark, folder).filter(contest.is_completed(F.col("game_state")))
    out = F.col("game_date") <= F.lit(PUBLISHED).cast("date")
    sides = games.groupBy("season").agg(F.max(out).alias("published"), F.max(~out).alias("live"))
    both = F.when(F.col("published") & F.col("live"), 1).otherwise(0)
    return sides.agg(F.sum(both).alias("shared"), F.count(F.lit(1)).alias("seasons"))


SQL_DISJOINT = with_views(
    "games_v",
    f"""p AS (SELECT DISTINCT season FROM games_v WHERE game_state = 'OFF' AND game_date <= DATE '{PUBLISHED}'),
l AS (SELECT DISTINCT season FROM games_v WHERE game_state = 'OFF' AND game_date > DATE '{PUBLISHED}')
SELECT (SELECT COUNT(*) FROM (SELECT season FROM p INTERSECT SELECT season FROM l) i) AS shared, COUNT(DISTINCT season) AS seasons FROM games_v WHERE game_state = 'OFF'""",
)


def status_counts(spark, folder):
    status = F.when(contest.is_completed(F.col("game_state")), "final").otherwise("upcoming")
    return standin.games(spark, folder).groupBy("season", status.alias("status")).agg(F.count(F.lit(1)).alias("games"))


SQL_STATUS = with_views("games_v", "SELECT season, CASE WHEN game_state = 'OFF' THEN 'final' ELSE 'upcoming' END AS status, COUNT(*) AS games FROM games_v GROUP BY 1, 2")


def teams_and_months(spark, folder):
    games = standin.games(spark, folder)
    teams = games.select(F.explode(F.array("home_team", "away_team").cast("array<string>")).alias("value")).distinct().withColumn("kind", F.lit("team"))
    months = games.select(calendar.month_key(F.col("game_date")).alias("value")).distinct().withColumn("kind", F.lit("month"))
    return teams.unionByName(months)


SQL_TEAMS_MONTHS = with_views(
    "games_v",
    """SELECT CAST(home_team AS VARCHAR) AS value, 'team' AS kind FROM games_v UNION SELECT CAST(away_team AS VARCHAR), 'team' FROM games_v
UNION SELECT strftime(game_date, '%Y-%m'), 'month' FROM games_v""",
)


def wanted_window(spark, folder):
    """Games to predict from two days: one inside the schedule and one before a gap that reaches to the next slate."""
    games = standin.games(spark, folder)
    near = board.wanted_games(games, "2001-06-15", 14).withColumn("view", F.lit("near"))
    far = board.wanted_games(games, "2001-04-01", 14).withColumn("view", F.lit("far"))
    return near.unionByName(far).select("view", "game_id", F.col("game_date").cast("string").alias("game_date"))


SQL_WANTED = with_views(
    "games_v",
    """SELECT 'near' AS "view", game_id, CAST(game_date AS VARCHAR) AS game_date FROM games_v WHERE game_state = 'FUT' AND game_date BETWEEN DATE '2001-06-15' AND DATE '2001-06-29'
UNION ALL SELECT 'far', game_id, CAST(game_date AS VARCHAR) FROM games_v WHERE game_state = 'FUT'
 AND game_date <= (SELECT MIN(game_date) FROM games_v WHERE game_state = 'FUT') + 5""",
)


def finished_since(spark, folder):
    rows = board.finished_since(standin.games(spark, folder), "2001-05-31", 21)
    return rows.select(
        "game_id", F.col("game_date").cast("string").alias("game_date"), "home_score", "away_score",
        F.col("last_period_type").isin("OT", "SO").alias("overtime"),
    )


SQL_FINISHED = with_views(
    "games_v",
    "SELECT game_id, CAST(game_date AS VARCHAR) AS game_date, home_score, away_score, last_period_type IN ('OT', 'SO') AS overtime FROM games_v WHERE game_state = 'OFF' AND game_date >= DATE '2001-05-31' - 21",
)


def first_seen_team(spark, folder):
    return board.first_seen(standin.games(spark, folder), ["score"])


SQL_FIRST = with_views(
    "games_v",
    """SELECT team, score FROM (SELECT home_team AS team, home_score AS score, game_date, game_id, 0 AS at_side FROM games_v
 UNION ALL SELECT away_team, away_score, game_date, game_id, 1 FROM games_v) t QUALIFY row_number() OVER (PARTITION BY team ORDER BY game_date, game_id, at_side) = 1""",
)


def season_calendar(spark, folder):
    """Season id, label, bounds and monthly snapshot dates of every season played."""
    seasons = standin.games(spark, folder).groupBy("season").agg(F.max("game_date").alias("stop"), F.count(F.lit(1)).alias("games"))
    s = F.col("season")
    made = seasons.select(
        "season", calendar.season_label(s).alias("label"), calendar.season_start(s).cast("string").alias("starts"),
        calendar.season_end(s).cast("string").alias("ends"), "games", F.explode(calendar.snapshot_dates(s, F.col("stop")).cast("array<string>")).alias("snapshot"),
    )
    return made


SQL_CALENDAR = with_views(
    "games_v",
    """s AS (SELECT season, MAX(game_date) AS stop, COUNT(*) AS games, make_date(season // 10000, 10, 1) AS st, make_date(season % 10000, 6, 30) AS en FROM games_v GROUP BY season),
d AS (SELECT season, st AS snapshot FROM s UNION SELECT season, least(en, stop) FROM s
 UNION SELECT season, CAST(unnest(generate_series(st + INTERVAL 1 MONTH, least(en, stop), INTERVAL 1 MONTH)) AS DATE) FROM s)
SELECT season, substr(CAST(season AS VARCHAR), 1, 4) || '-' || substr(CAST(season AS VARCHAR), 7, 2) AS label, CAST(st AS VARCHAR) AS starts, CAST(en AS VARCHAR) AS ends, games, CAST(snapshot AS VARCHAR) AS snapshot
FROM s JOIN d USING (season)""",
)


def clock_and_fraction(spark, folder):
    """Clocks to seconds, periods to game time, fraction parts and texts over every skater line."""
    rows = standin.skater_lines(spark, folder)
    period = F.col("hits")
    seconds = calendar.game_seconds(period, F.col("time_on_ice"))
    live = calendar.game_seconds(period, F.col("time_on_ice"), live=True)
    part = F.concat_ws("/", F.col("goals").cast("string"), F.col("points").cast("string"))
    return rows.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(calendar.clock_seconds(F.col("time_on_ice"))).alias("clock"),
        F.sum(seconds).alias("game_seconds"),
        F.sum(live).alias("live_seconds"),
        F.sum(calendar.remaining_regulation(live)).alias("remaining_regulation"),
        F.sum(calendar.remaining_game(live, F.lit(5))).alias("remaining_game"),
        F.sum(contest.fraction_part(part, 0)).alias("first_part"),
        F.sum(contest.fraction_part(part, 1)).alias("second_part"),
    )


_ELAPSED = "CASE WHEN hits <= 3 THEN (hits - 1) * 1200 + toi_seconds ELSE 3600 + (hits - 4) * 300 + toi_seconds END"
_LIVE = f"CASE WHEN hits <= 0 THEN 0 ELSE {_ELAPSED} END"
SQL_CLOCK = with_views(
    "skaters_v",
    f"""SELECT hits AS period, COUNT(*) AS lines, CAST(SUM(toi_seconds) AS BIGINT) AS clock, CAST(SUM({_ELAPSED}) AS BIGINT) AS game_seconds, CAST(SUM({_LIVE}) AS BIGINT) AS live_seconds,
 CAST(SUM(greatest(0, 3600 - least({_LIVE}, 3600))) AS BIGINT) AS remaining_regulation, CAST(SUM(greatest(0, 4200 - ({_LIVE}))) AS BIGINT) AS remaining_game,
 CAST(SUM(goals) AS BIGINT) AS first_part, CAST(SUM(points) AS BIGINT) AS second_part FROM skaters_v GROUP BY hits""",
)


def display_texts(spark, folder):
    """Names, records, odds and times as they are shown, over every customer."""
    c = standin.table(spark, folder, "customer")
    full = F.regexp_replace("c_name", "#", " No ")
    name = contest.club_name(full, F.col("c_nationkey") == 7)
    odds = contest.fair_odds(F.abs("c_acctbal") % 1000 / 1000)
    return c.select(
        "c_custkey",
        name.alias("name"),
        contest.club_city(full, contest.club_name(full)).alias("city"),
        contest.record(F.col("c_custkey") % 50, F.col("c_custkey") % 30, F.col("c_nationkey")).alias("record"),
        contest.streak_code(F.when(F.col("c_custkey") % 3 > 0, "W"), F.col("c_custkey") % 9).alias("streak"),
        signed(odds).alias("odds"),
        calendar.short_time(
            F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("2001-06-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit("T23:05:00Z"))),
            F.lit("2001-06-30"),
        ).alias("shown_time"),
        F.size(contest.form_list(F.regexp_replace("c_mktsegment", "[AEIOU]", ","))).cast("long").alias("form_parts"),
    )


SQL_TEXTS = """SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'Hockey Club' ELSE split_part(c_name, '#', 2) END AS name, split_part(c_name, '#', 1) || ' No' AS city,
 CAST(c_custkey % 50 AS VARCHAR) || '-' || CAST(c_custkey % 30 AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR) AS record,
 CASE WHEN c_custkey % 3 > 0 THEN 'W' ELSE '' END || CAST(c_custkey % 9 AS VARCHAR) AS streak,
 CASE WHEN o > 0 THEN '+' ELSE '' END || CAST(o AS VARCHAR) AS odds,
 CASE WHEN c_custkey % 4 > 0 THEN strftime(make_timestamp(2001, 6, c_custkey % 28 + 1, 23, 5, 0), '%a %d %b, %H:%M UTC') ELSE '2001-06-30' END AS shown_time,
 len(list_filter(string_split(regexp_replace(c_mktsegment, '[AEIOU]', ',', 'g'), ','), lambda x: x <> '')) AS form_parts
FROM (SELECT *, CAST(round_even(CASE WHEN p >= 0.5 THEN -100 * p / (1 - p) ELSE 100 * (1 - p) / p END, 0) AS BIGINT) AS o
 FROM (SELECT *, least(greatest(abs(c_acctbal) % 1000 / 1000, 0.02::DOUBLE), 1 - 0.02::DOUBLE) AS p FROM customer) a) b"""

QUERIES = {
    "settle_picks": (settle_picks, SQL_SETTLE),
    "member_leaderboard": (member_leaderboard, SQL_LEADERBOARD),
    "current_streak": (current_streak, SQL_STREAK),
    "pending_picks": (pending_picks, SQL_PENDING),
    "strategy_backtest": (strategy_backtest, SQL_STRATEGY),
    "latest_picks": (latest_picks, SQL_LATEST),
    "results_page": (results_page, SQL_PAGE),
    "graded_results": (graded_results, SQL_GRADED),
    "season_review": (season_review, SQL_REVIEW),
    "last_five_form": (last_five_form, SQL_FORM),
    "comment_threads": (comment_threads, SQL_COMMENTS),
    "like_toggle": (like_toggle, SQL_LIKES),
    "matchup_comparison": (matchup_comparison, SQL_COMPARE),
    "shown_season": (shown_season, SQL_SHOWN),
    "featured_games": (featured_games, SQL_FEATURED),
    "replay_choice": (replay_choice, SQL_REPLAY),
    "pair_join_dedupe": (pair_join_dedupe, SQL_PAIR),
    "games_with_teams": (games_with_teams, SQL_GAMES_TEAMS),
    "upsert_upcoming": (upsert_upcoming, SQL_UPSERT),
    "apply_results": (apply_results, SQL_APPLY),
    "insert_if_absent": (insert_if_absent, SQL_INSERT),
    "upsert_teams": (upsert_teams, SQL_TEAMS),
    "metadata_upsert": (metadata_upsert, SQL_META),
    "missing_artifacts": (missing_artifacts, SQL_MISSING),
    "dq_report": (dq_report, SQL_DQ),
    "leakage_check": (leakage_check, SQL_LEAK),
    "season_disjoint": (season_disjoint, SQL_DISJOINT),
    "status_counts": (status_counts, SQL_STATUS),
    "teams_and_months": (teams_and_months, SQL_TEAMS_MONTHS),
    "wanted_window": (wanted_window, SQL_WANTED),
    "finished_since": (finished_since, SQL_FINISHED),
    "first_seen_team": (first_seen_team, SQL_FIRST),
    "season_calendar": (season_calendar, SQL_CALENDAR),
    "clock_and_fraction": (clock_and_fraction, SQL_CLOCK),
    "display_texts": (display_texts, SQL_TEXTS),
}
