"""Registered queries over feed documents derived from the sample tables, and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contest
from ..operators import board, history, live, ratings, scores, serving
from ..session import materialise
from ..sources import documents, flatten, landing, standin
from .catalog_form import HIST
from .catalog_live import W
from .catalog_scores import G, RIGHT, rnd
from .views_sql import with_views


def _parsed(docs, schema, carry, column="text"):
    return docs.select(*carry, F.from_json(column, schema).alias("doc")).select(*carry, "doc.*")


def _schedule_docs(spark, folder):
    return _parsed(documents.schedules(spark, folder), flatten.SCHEDULE, ["club", "day", "part"])


def flatten_schedule(spark, folder):
    return flatten.schedule_table(_schedule_docs(spark, folder), ["club", "day", "part"])


_T = "'T' || CAST({0} AS VARCHAR)"
SQL_SCHEDULE = with_views(
    "games_v",
    f"""SELECT game_id, season, game_type, CAST(game_date AS VARCHAR) AS game_date, 'Arena ' || CAST(greatest(home_team, away_team) AS VARCHAR) AS venue,
 {_T.format('home_team')} AS home_team, {_T.format('away_team')} AS away_team, home_score, away_score,
 CASE WHEN game_state = 'OFF' THEN CAST(home_score > away_score AS BIGINT) END AS home_win, game_state, CAST(game_date AS VARCHAR) || 'T23:00:00Z' AS start_time_utc FROM games_v""",
)


def first_schedule_wins(spark, folder):
    made = flatten.schedule_table(_schedule_docs(spark, folder), ["club", "day", "part"], last_wins=False)
    return made.select("game_id", "venue", "home_team", "away_team", "home_win")


SQL_FIRST = with_views(
    "games_v",
    f"""SELECT game_id, 'Arena ' || CAST(least(home_team, away_team) AS VARCHAR) AS venue, {_T.format('home_team')} AS home_team, {_T.format('away_team')} AS away_team,
 CASE WHEN game_state = 'OFF' THEN CAST(home_score > away_score AS BIGINT) END AS home_win FROM games_v""",
)


def serving_schedule(spark, folder):
    from ..operators.store import keep_last

    rows = flatten.flatten_serving_game(flatten.games_of(_schedule_docs(spark, folder), ["club", "day", "part"]))
    return keep_last(rows, ["game_id"], ["venue"]).drop("venue").withColumn("game_date", F.col("game_date").cast("string"))


SQL_SERVING = with_views(
    "games_v",
    "SELECT game_id, season, game_type, CAST(game_date AS VARCHAR) AS game_date, CAST(game_date AS VARCHAR) || 'T23:00:00Z' AS start_time_utc, "
    + ", ".join(
        f"'T' || CAST({s}_team AS VARCHAR) AS {s}_team, 'logo/' || CAST({s}_team AS VARCHAR) AS {s}_logo, 'Name' || CAST({s}_team AS VARCHAR) AS {s}_name, "
        f"'City' || CAST({s}_team AS VARCHAR) AS {s}_city, CASE WHEN game_state = 'OFF' THEN {s}_score END AS {s}_score"
        for s in ("home", "away")
    )
    + ", last_period_type, game_state AS state, game_state = 'OFF' AS finished FROM games_v",
)


def upcoming_split(spark, folder):
    return flatten.upcoming(flatten_schedule(spark, folder)).select("game_id", "game_date", "home_team", "away_team", "game_state")


SQL_UPCOMING = with_views(
    "games_v",
    f"SELECT game_id, CAST(game_date AS VARCHAR) AS game_date, {_T.format('home_team')} AS home_team, {_T.format('away_team')} AS away_team, game_state FROM games_v WHERE game_state = 'FUT'",
)


def _box_docs(spark, folder):
    docs = documents.box_scores(spark, folder)
    box = F.from_json("box", flatten.BOXSCORE).alias("b")
    rail = F.from_json("rail", flatten.RAIL).alias("r")
    return docs.select("game_id", "season", "game_date", "home_team", "away_team", box, rail).select(
        "game_id", "season", "game_date", "home_team", "away_team", "b.*", "r.*"
    )


def flatten_team_lines(spark, folder):
    made = flatten.team_rows(_box_docs(spark, folder))
    return made.withColumn("faceoff_win_pct", F.rint(F.col("faceoff_win_pct") * 1e6) / 1e6)


_SLOTS = """
sl AS (SELECT l_orderkey AS game_id, l_linenumber % 2 AS is_home, l_partkey % 20 AS slot, SUM(l_suppkey % 3) AS goals, SUM(l_partkey % 3) AS assists,
  SUM(l_partkey % 7) AS hits, SUM(l_suppkey % 5) AS blocked, SUM(l_linenumber) AS pim, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ppg,
  SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS giveaways, SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS takeaways,
  SUM(CAST(l_quantity AS BIGINT)) AS sog, MAX(l_discount) AS fo FROM lineitem GROUP BY ALL),
sides AS (SELECT g.*, 1 AS is_home, home_team AS team, away_team AS opponent, home_score AS gf, away_score AS ga FROM games_v g
  UNION ALL SELECT g.*, 0, away_team, home_team, away_score, home_score FROM games_v g),
tot AS (SELECT game_id, is_home, SUM(hits) AS hits, SUM(blocked) AS blocked, SUM(pim) AS pim, SUM(ppg) AS ppg, SUM(giveaways) AS giveaways, SUM(takeaways) AS takeaways, SUM(sog) AS sog,
  list(fo ORDER BY slot) FILTER (WHERE fo > 0) AS fos FROM sl GROUP BY ALL)"""


def _d(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


SQL_TEAM_LINES = with_views(
    "games_v",
    _SLOTS + f"""
SELECT s.game_id, s.season, CAST(s.game_date AS VARCHAR) AS game_date, {_T.format('s.team')} AS team, {_T.format('s.opponent')} AS opponent, CAST(s.is_home AS BIGINT) AS is_home,
 s.gf AS goals_for, s.ga AS goals_against,
 {_d('COALESCE(t.sog, 0) + CASE WHEN s.game_id % 3 > 0 THEN 1 ELSE 0 END')} AS shots_for, {_d('COALESCE(o.sog, 0) + CASE WHEN s.game_id % 3 > 0 THEN 1 ELSE 0 END')} AS shots_against,
 {_d('COALESCE(t.ppg, 0)')} AS powerplay_goals, CAST(CASE WHEN s.game_id % 3 > 0 THEN COALESCE(t.ppg, 0) + 2 END AS BIGINT) AS powerplay_opportunities,
 {_d('COALESCE(t.pim, 0)')} AS penalty_minutes, {rnd('list_reduce(t.fos, lambda a, b: a + b) / len(t.fos)', 6)} AS faceoff_win_pct,
 {_d('COALESCE(t.blocked, 0)')} AS blocked_shots, {_d('COALESCE(t.hits, 0) + CASE WHEN s.game_id % 3 > 0 THEN 2 ELSE 0 END')} AS hits,
 {_d('COALESCE(t.giveaways, 0)')} AS giveaways, {_d('COALESCE(t.takeaways, 0)')} AS takeaways
FROM sides s LEFT JOIN tot t ON t.game_id = s.game_id AND t.is_home = s.is_home LEFT JOIN tot o ON o.game_id = s.game_id AND o.is_home = 1 - s.is_home
WHERE s.game_id IN (SELECT game_id FROM tot)""",
)


def flatten_skaters(spark, folder):
    return flatten.skater_rows(_box_docs(spark, folder)).drop("season", "game_date")


SQL_SKATER_ROWS = with_views(
    "games_v",
    _SLOTS + f"""
SELECT s.game_id, {_T.format('s.team')} AS team, {_T.format('s.opponent')} AS opponent, slot AS player_id, 'P' || CAST(slot AS VARCHAR) AS player_name, 'C' AS position,
 CAST(goals AS BIGINT) AS goals, CAST(assists AS BIGINT) AS assists, CAST(goals + assists AS BIGINT) AS points, CAST(sog AS BIGINT) AS shots, CAST(hits AS BIGINT) AS hits,
 CAST(blocked AS BIGINT) AS blocked_shots, CAST(pim AS BIGINT) AS pim, CAST(goals - assists AS BIGINT) AS plus_minus,
 lpad(CAST(sog % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(hits % 60 AS VARCHAR), 2, '0') AS time_on_ice
FROM sl JOIN sides s ON s.game_id = sl.game_id AND s.is_home = sl.is_home""",
)


def flatten_goalies(spark, folder):
    return flatten.goalie_rows(_box_docs(spark, folder)).drop("season", "game_date")


_GOALIE_SQL = """
gl AS (SELECT l_orderkey AS game_id, l_linenumber % 2 AS is_home, l_suppkey % 2 AS slot, CAST(SUM(l_partkey % 30 + 20) AS BIGINT) AS shots, CAST(SUM(l_partkey % 6) AS BIGINT) AS against,
  SUM(CAST(l_quantity AS BIGINT)) AS minutes FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)"""
SQL_GOALIE_ROWS = with_views(
    "games_v",
    _SLOTS + "," + _GOALIE_SQL + f"""
SELECT s.game_id, {_T.format('s.team')} AS team, {_T.format('s.opponent')} AS opponent, slot AS player_id, 'G' || CAST(slot AS VARCHAR) AS goalie_name, shots AS shots_against,
 shots - against AS saves, against AS goals_against, {rnd('CAST(shots - against AS DOUBLE) / shots', 3)} AS save_pct, 'W' AS decision,
 CASE WHEN minutes < 10 THEN '0' ELSE '' END || CAST(minutes AS VARCHAR) || ':00' AS time_on_ice, row_number() OVER (PARTITION BY s.game_id, s.is_home ORDER BY slot) - 1 AS line
FROM gl JOIN sides s ON s.game_id = gl.game_id AND s.is_home = gl.is_home""",
)


def document_starters(spark, folder):
    return flatten.game_starters(_box_docs(spark, folder))


SQL_DOC_STARTERS = with_views(
    "games_v",
    _GOALIE_SQL + """, b AS (SELECT game_id, is_home, arg_max(slot, minutes * 10 - slot) AS slot FROM gl GROUP BY game_id, is_home)
SELECT g.game_id, h.slot AS home_starter, a.slot AS away_starter FROM (SELECT DISTINCT l_orderkey AS game_id FROM lineitem) l JOIN games_v g USING (game_id)
LEFT JOIN b h ON h.game_id = g.game_id AND h.is_home = 1 LEFT JOIN b a ON a.game_id = g.game_id AND a.is_home = 0""",
)


def _play_rows(spark, folder):
    return flatten.play_rows(_parsed(documents.play_by_play(spark, folder), flatten.PLAY_BY_PLAY, []))


PLAY_COLUMNS = (
    "game_id", "event_id", "sort_order", "period", "period_type", "period_time", "seconds_elapsed", "period_seconds_elapsed", "event_type", "team", "team_id",
    "team_side", "player_1", "player_2", "shooting_player_id", "goalie_in_net_id", "committed_by_player_id", "drawn_by_player_id", "winning_player_id", "x_coord",
    "strength", "situation_code", "penalty_minutes", "reason", "home_score", "away_score", "description",
)


def flatten_plays(spark, folder):
    made = _play_rows(spark, folder)
    parsed = F.from_json("raw_details_json", "eventOwnerTeamId bigint, xCoord bigint")
    checked = made.withColumn("details_ok", (parsed["eventOwnerTeamId"] == F.col("team_id")) & (parsed["xCoord"] == F.col("x_coord")))
    return checked.select(*PLAY_COLUMNS, "details_ok")


_SHOT = "event_type IN ('goal', 'shot-on-goal')"
_PLAY_SQL = """
p AS (SELECT *, CASE WHEN seconds_elapsed >= 3600 THEN 4 + (seconds_elapsed - 3600) // 300 ELSE seconds_elapsed // 1200 + 1 END AS period FROM plays_v),
q AS (SELECT *, seconds_elapsed - CASE WHEN period <= 3 THEN (period - 1) * 1200 ELSE 3600 + (period - 4) * 300 END AS ins,
  CASE WHEN event_type = 'goal' AND sort_order % 4 = 0 THEN sort_order // 8 END AS hs, CASE WHEN event_type = 'goal' AND sort_order % 4 = 0 THEN sort_order // 12 END AS aws FROM p)"""
SQL_PLAYS = with_views(
    "plays_v",
    _PLAY_SQL + f"""
SELECT game_id, event_id, sort_order, CAST(period AS BIGINT) AS period, CASE WHEN period <= 3 THEN 'REG' ELSE 'OT' END AS period_type,
 lpad(CAST(ins // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ins % 60 AS VARCHAR), 2, '0') AS period_time, seconds_elapsed, CAST(ins AS BIGINT) AS period_seconds_elapsed, event_type,
 CASE WHEN side = 'home' THEN 'HOM' ELSE 'AWY' END AS team, CAST(CASE WHEN side = 'home' THEN 1 ELSE 2 END AS BIGINT) AS team_id, side AS team_side,
 CASE WHEN {_SHOT} THEN event_id % 50 WHEN event_type = 'penalty' THEN event_id % 40 WHEN event_type = 'faceoff' THEN event_id % 20 END AS player_1,
 CASE WHEN event_type = 'penalty' THEN event_id % 30 END AS player_2, CASE WHEN {_SHOT} THEN event_id % 50 END AS shooting_player_id,
 CASE WHEN {_SHOT} THEN 100 + sort_order % 3 END AS goalie_in_net_id, CASE WHEN event_type = 'penalty' THEN event_id % 40 END AS committed_by_player_id,
 CASE WHEN event_type = 'penalty' THEN event_id % 30 END AS drawn_by_player_id, CASE WHEN event_type = 'faceoff' THEN event_id % 20 END AS winning_player_id,
 CAST(sort_order % 90 AS DOUBLE) AS x_coord, situation_code AS strength, situation_code, CAST(penalty_minutes AS DOUBLE) AS penalty_minutes,
 CASE WHEN event_type = 'penalty' THEN 'hooking' END AS reason, hs AS home_score, aws AS away_score,
 CASE WHEN event_type = 'penalty' THEN 'hooking' ELSE event_type END || ' event_id=' || CAST(event_id AS VARCHAR) AS description, true AS details_ok FROM q""",
)


def state_from_documents(spark, folder):
    """Stated scores override the count, and goalies follow the shots, over flattened play documents."""
    plays = materialise(flatten.live_events(_play_rows(spark, folder)), "document-plays")
    state = live.running_state(live.GameEvents(plays))
    timed = live.with_clock(state, F.lit(5))
    return timed.select(
        "game_id", "event_id", "home_score", "away_score", "home_goalie_id", "away_goalie_id", "seconds_remaining_regulation",
        "seconds_remaining_game", "game_progress", F.col("home_penalty_minutes").cast("long").alias("home_penalty_minutes"),
    )


SQL_DOC_STATE = with_views(
    "plays_v",
    _PLAY_SQL + f""",
step AS (SELECT game_id, CAST(0 AS BIGINT) AS sort_order, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS h, CAST(0 AS BIGINT) AS a FROM (SELECT DISTINCT game_id FROM q) t
 UNION ALL SELECT n.game_id, n.sort_order, n.event_id,
  CAST(CASE WHEN n.event_type <> 'goal' THEN s.h WHEN n.side = 'home' THEN COALESCE(nullif(n.hs, 0), s.h + 1) ELSE COALESCE(n.hs, s.h) END AS BIGINT),
  CAST(CASE WHEN n.event_type <> 'goal' THEN s.a WHEN n.side = 'away' THEN COALESCE(nullif(n.aws, 0), s.a + 1) ELSE COALESCE(n.aws, s.a) END AS BIGINT)
 FROM step s JOIN q n ON n.game_id = s.game_id AND n.sort_order = s.sort_order + 1),
o AS (SELECT *, last_value(CASE WHEN {_SHOT} AND side = 'away' THEN 100 + sort_order % 3 END IGNORE NULLS) {W} AS home_goalie_id,
  last_value(CASE WHEN {_SHOT} AND side = 'home' THEN 100 + sort_order % 3 END IGNORE NULLS) {W} AS away_goalie_id,
  CAST(SUM(CASE WHEN side = 'home' THEN COALESCE(penalty_minutes, 0) ELSE 0 END) {W} AS BIGINT) AS home_penalty_minutes FROM q)
SELECT o.game_id, o.event_id, s.h AS home_score, s.a AS away_score, home_goalie_id, away_goalie_id, greatest(0, 3600 - least(seconds_elapsed, 3600)) AS seconds_remaining_regulation,
 greatest(0, 4200 - seconds_elapsed) AS seconds_remaining_game, {rnd('seconds_elapsed / 4200.0::DOUBLE', 5)} AS game_progress, home_penalty_minutes
FROM o JOIN step s ON s.game_id = o.game_id AND s.sort_order = o.sort_order""",
    recursive=True,
)


def live_state_rows(spark, folder):
    """The full state row of every event of the flattened documents, checked by columns that no other query covers.

    Documents and plays are written once: every scan reads its input twice, and scans read scans.
    """
    docs = materialise(_parsed(documents.play_by_play(spark, folder), flatten.PLAY_BY_PLAY, []), "play-documents")
    events = live.GameEvents(materialise(flatten.live_events(flatten.play_rows(docs)), "document-plays"))
    rows = live.state_rows(events, flatten.game_context(docs))
    return rows.select(
        "game_id", "event_id", F.col("event_index").cast("long").alias("event_index"), "season", "home_team", "away_team", "event_team", "event_team_side", "period", "period_type",
        "time_in_period", "seconds_elapsed", "home_active_penalties", "away_active_penalty_seconds", "home_score", "away_score",
        F.col("penalty_minute_diff_home").cast("long").alias("penalty_minute_diff_home"), F.col("sog_diff_home").cast("long").alias("sog_diff_home"),
        "penalty_minutes_event", "reason", "goalie_in_net_id", "drawn_by_player_id", "target_home_win",
    )


def latest_standings(spark, folder):
    docs = _parsed(documents.standings(spark, folder), flatten.STANDINGS, ["season", "snapshot_date"])
    rows = landing.latest_snapshot(flatten.standings_rows(docs), "snapshot_date", ("season",))
    return rows.select(
        "season", "snapshot_date", "team", "team_name", "points", "games_played",
        contest.record(F.col("wins"), F.col("losses"), F.col("ot_losses")).alias("record"),
        contest.streak_code(F.col("streak_code"), F.col("streak_count")).alias("streak"),
    )


SQL_STANDINGS = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + """,
r AS (SELECT season, strftime(game_date, '%Y-%m') AS month, team, CAST(SUM(win) AS BIGINT) AS w, CAST(SUM(CASE WHEN win = 0 AND last_period_type <> 'OT' THEN 1 ELSE 0 END) AS BIGINT) AS l,
  CAST(SUM(CASE WHEN win = 0 AND last_period_type = 'OT' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM hist GROUP BY ALL)
SELECT season, month || '-28' AS snapshot_date, 'T' || CAST(team AS VARCHAR) AS team, 'City Name' || CAST(team AS VARCHAR) AS team_name, 2 * w + o AS points, w + l + o AS games_played,
 CAST(w AS VARCHAR) || '-' || CAST(l AS VARCHAR) || '-' || CAST(o AS VARCHAR) AS record, 'W' || CAST(w % 5 AS VARCHAR) AS streak
FROM r WHERE (season, month) IN (SELECT (season, max(month)) FROM r GROUP BY season)""",
)


def rosters(spark, folder):
    docs = _parsed(documents.rosters(spark, folder), flatten.ROSTER, ["team"])
    return flatten.roster_rows(docs).select("team", "group", "player_id", "player_name", "position", "sweater_number")


SQL_ROSTERS = """SELECT CAST(c_nationkey AS BIGINT) AS team, CASE c_custkey % 3 WHEN 0 THEN 'forwards' WHEN 1 THEN 'defensemen' ELSE 'goalies' END AS "group", c_custkey AS player_id,
 'First ' || split_part(c_name, '#', 2) AS player_name, substr(c_mktsegment, 1, 1) AS position, c_custkey % 99 AS sweater_number FROM customer"""


def live_snapshot(spark, folder):
    docs = landing.latest_snapshot(_parsed(documents.snapshots(spark, folder), flatten.SCHEDULE, ["snapshot_id", "part"]))
    games = flatten.schedule_table(docs, ["snapshot_id", "part"])
    return games.filter(F.col("game_state").isin(*contest.LIVE)).select("game_id", "game_date", "home_team", "away_team", "game_state")


SQL_SNAPSHOT = with_views(
    "games_v",
    f"SELECT game_id, CAST(game_date AS VARCHAR) AS game_date, {_T.format('home_team')} AS home_team, {_T.format('away_team')} AS away_team, 'LIVE' AS game_state FROM games_v WHERE game_state = 'FUT' AND game_date <= DATE '2001-07-01'",
)


def club_season_stats(spark, folder):
    """Season pages of team statistics, concatenated and scaled, joined to the team directory by name."""
    done = history.team_games(history.eligible(standin.games(spark, folder)))
    per = done.groupBy("season", "team").agg(F.avg("goals_for").alias("gf"), F.avg("goals_against").alias("ga"), F.avg("win").alias("w"), F.count(F.lit(1)).alias("n"))
    entry = F.struct(
        F.concat(F.lit("City Name"), F.col("team").cast("string")).alias("teamFullName"), F.col("gf").alias("goalsForPerGame"), F.col("ga").alias("goalsAgainstPerGame"),
        F.col("w").alias("powerPlayPct"), (1 - F.col("w")).alias("penaltyKillPct"), (F.col("gf") * 10).alias("shotsForPerGame"), (F.col("ga") * 10).alias("shotsAgainstPerGame"),
        F.when(F.col("team") % 4 > 0, F.col("w") / 2).alias("faceoffWinPct"), F.col("n").alias("gamesPlayed"),
    )
    pages = per.groupBy("season", F.floor(F.col("team") / 10).alias("page")).agg(F.collect_list(entry).alias("data"))
    text = pages.select("season", "page", F.to_json(F.struct("data")).alias("text"))
    shape = (
        "data array<struct<teamFullName:string,goalsForPerGame:double,goalsAgainstPerGame:double,powerPlayPct:double,penaltyKillPct:double,"
        "shotsForPerGame:double,shotsAgainstPerGame:double,faceoffWinPct:double,gamesPlayed:bigint>>"
    )
    rows = flatten.page_rows(_parsed(text, shape, ["season", "page"]), ("season",))
    directory = standin.teams(spark, folder).select(
        F.col("team").alias("id"), F.concat(F.lit("City Name"), F.col("team").cast("string")).alias("fullName"),
        F.when(F.col("team") % 2 == 0, F.concat(F.lit("T"), F.col("team").cast("string"))).alias("triCode"),
        F.concat(F.lit("R"), F.col("team").cast("string")).alias("rawTricode"),
    )
    codes = flatten.team_codes(directory)
    stats = flatten.club_stats(rows, codes)
    return stats.groupBy("code").agg(*[F.count(F.lit(1)).alias("seasons")], *[F.max(c).alias(c) for c in stats.columns if c != "code"])


def _shown(e: str, n: int) -> str:
    return rnd(f"COALESCE({e}, 0)", n)


SQL_CLUBS = with_views(
    "games_v",
    HIST.format(types="(2, 3)") + f""", per AS (SELECT season, team, avg(goals_for) AS gf, avg(goals_against) AS ga, avg(win) AS w, COUNT(*) AS n FROM hist GROUP BY season, team)
SELECT CASE WHEN team % 2 = 0 THEN 'T' ELSE 'R' END || CAST(team AS VARCHAR) AS code, COUNT(*) AS seasons, MAX({_shown('gf', 2)}) AS goals_for, MAX({_shown('ga', 2)}) AS goals_against,
 MAX({_shown('w * 100', 1)}) AS power_play, MAX({_shown('(1 - w) * 100', 1)}) AS penalty_kill, MAX({_shown('gf * 10', 1)}) AS shots_per_game, MAX({_shown('ga * 10', 1)}) AS shots_against,
 MAX({_shown('CASE WHEN team % 4 > 0 THEN w / 2 * 100 END', 1)}) AS faceoff_win, MAX(n) AS games_played FROM per GROUP BY team""",
)


def active_teams(spark, folder):
    """Codes of the teams with games in a season, and all codes for a season without any."""
    directory = standin.teams(spark, folder).select(
        F.col("team").alias("id"), F.col("name").alias("fullName"), F.concat(F.lit("T"), F.col("team").cast("string")).alias("triCode"), F.lit(None).cast("string").alias("rawTricode")
    )
    codes = flatten.team_codes(directory)
    played = standin.games(spark, folder).select("season", F.col("home_team").alias("teamId"))
    some = flatten.active_codes(codes, played.filter(F.col("season") == 20002001)).withColumn("season", F.lit("20002001"))
    none = flatten.active_codes(codes, played.filter(F.col("season") == 20302031)).withColumn("season", F.lit("20302031"))
    return some.unionByName(none)


SQL_ACTIVE = with_views(
    "games_v",
    """SELECT DISTINCT 'T' || CAST(home_team AS VARCHAR) AS code, '20002001' AS season FROM games_v WHERE season = 20002001
UNION ALL SELECT 'T' || CAST(n_nationkey AS VARCHAR), '20302031' FROM nation""",
)


def standings_end(spark, folder):
    calendar = standin.games(spark, folder).groupBy(F.col("season").alias("id")).agg(F.max("game_date").cast("string").alias("standingsEnd"))
    parts = [flatten.standings_end(calendar, s, d).withColumn("season", F.lit(s).cast("long")) for s, d in ((19981999, "2001-05-01"), (20002001, "2001-05-01"), (20302031, "2001-05-01"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("standings_end", F.col("standings_end").cast("string"))


SQL_STANDINGS_END = with_views(
    "games_v",
    """s AS (SELECT * FROM (VALUES (19981999), (20002001), (20302031)) v(season))
SELECT CAST(s.season AS BIGINT) AS season, CAST(least(COALESCE(MAX(game_date), DATE '2001-05-01'), DATE '2001-05-01') AS VARCHAR) AS standings_end
FROM s LEFT JOIN games_v g ON g.season = s.season GROUP BY s.season""",
)

# ---- exports ---------------------------------------------------------------------------------------------------


def season_history_export(spark, folder):
    """A season's export in sections: every graded game, monthly accuracy and the summary; one row per document."""
    preds = standin.predictions(spark, folder).filter(contest.is_completed(F.col("game_state")) & (F.col("season") == 20002001))
    p, y = F.col("p_home"), F.col("y")
    home, away = F.col("home_team"), F.col("away_team")
    games = preds.select(
        F.col("game_id").alias("gameId"), F.col("game_date").cast("string").alias("gameDate"), home.alias("home"), away.alias("away"),
        F.col("home_score").alias("homeScore"), F.col("away_score").alias("awayScore"),
        F.when(contest.pick_home(p), home).otherwise(away).alias("pick"), F.when(y == 1, home).otherwise(away).alias("winner"),
        contest.is_right(p, y).alias("correct"), (F.col("game_type") == contest.PLAYOFF).alias("playoff"),
    )
    sure = contest.confidence(p) >= 0.6
    right = contest.is_right(p, y).cast("long")
    summary = preds.agg(
        F.count(F.lit(1)).alias("games"), (F.rint(100 * F.avg(right) * 10) / 10).alias("accuracy"), F.sum(right).alias("correctPicks"),
        F.sum(sure.cast("long")).alias("confidentGames"), (F.rint(100 * F.avg(F.when(sure, right)) * 10) / 10).alias("confidentAccuracy"),
    )
    sections = {"games": games, "monthly": scores.monthly_accuracy(preds), "summary": summary}
    return landing.sections_frame(sections)


SQL_EXPORT = with_views(
    "preds_v",
    f"""{G}, s AS (SELECT *, p_home AS p FROM graded WHERE season = 20002001)
SELECT 'games' AS section, CAST(to_json({{'gameId': game_id, 'gameDate': CAST(game_date AS VARCHAR), 'home': home_team, 'away': away_team, 'homeScore': home_score, 'awayScore': away_score,
  'pick': CASE WHEN p >= 0.5 THEN home_team ELSE away_team END, 'winner': CASE WHEN y = 1 THEN home_team ELSE away_team END, 'correct': (p >= 0.5) = (y = 1), 'playoff': game_type = 3}}) AS VARCHAR) AS document FROM s
UNION ALL SELECT 'monthly', CAST(to_json({{'month': month, 'games': games, 'accuracy': accuracy}}) AS VARCHAR)
 FROM (SELECT strftime(game_date, '%Y-%m') AS month, COUNT(*) AS games, {rnd(f'100 * avg({RIGHT})', 1)} AS accuracy FROM s GROUP BY 1) m
UNION ALL SELECT 'summary', CAST(to_json({{'games': games, 'accuracy': accuracy, 'correctPicks': hits, 'confidentGames': cg, 'confidentAccuracy': ca}}) AS VARCHAR)
 FROM (SELECT COUNT(*) AS games, {rnd(f'100 * avg({RIGHT})', 1)} AS accuracy, CAST(SUM({RIGHT}) AS BIGINT) AS hits, COUNT(*) FILTER (WHERE greatest(p, 1 - p) >= 0.6) AS cg,
   {rnd(f'100 * avg({RIGHT}) FILTER (WHERE greatest(p, 1 - p) >= 0.6)', 1)} AS ca FROM s) t""",
)


def hero_summary(spark, folder):
    """Headline numbers in one row: confident picks, games tracked, updates per game."""
    preds = standin.predictions(spark, folder).filter(contest.is_completed(F.col("game_state")))
    p, y = F.col("p_home"), F.col("y")
    sure = contest.confidence(p) >= 0.6
    right = contest.is_right(p, y).cast("long")
    main = preds.agg(
        (F.rint(100 * F.avg(F.when(sure, right)) * 10) / 10).alias("confident_accuracy"), F.sum(sure.cast("long")).alias("confident_games"),
        F.count(F.lit(1)).alias("predicted_games"), (F.rint(100 * F.avg(F.when(F.col("season") == 20002001, right)) * 10) / 10).alias("season_accuracy"),
    )
    updates = standin.table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.floor(F.median("n")).cast("long").alias("live_updates_per_game")
    )
    return main.join(F.broadcast(updates))  # one row each


SQL_HERO = with_views(
    "preds_v",
    f"""{G}, s AS (SELECT *, p_home AS p FROM graded)
SELECT {rnd(f'100 * avg({RIGHT}) FILTER (WHERE greatest(p, 1 - p) >= 0.6)', 1)} AS confident_accuracy, COUNT(*) FILTER (WHERE greatest(p, 1 - p) >= 0.6) AS confident_games,
 COUNT(*) AS predicted_games, {rnd(f'100 * avg({RIGHT}) FILTER (WHERE season = 20002001)', 1)} AS season_accuracy,
 (SELECT CAST(floor(median(n)) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM events GROUP BY user_id) t) AS live_updates_per_game FROM s""",
)


def team_table(spark, folder):
    """Standings, form, rating and first-seen details per team in one table, by points."""


    games = standin.games(spark, folder)
    done = history.eligible(games)
    rows = history.team_games(done.filter(F.col("season") == 20002001))
    table = rows.groupBy("team").agg(
        F.sum(F.col("win").cast("long")).alias("wins"), F.sum((1 - F.col("win")).cast("long")).alias("losses"), F.sum("points").cast("long").alias("points")
    )
    form = board.last_form(rows, ["team"], overtime=True)
    states = ratings.state_export(ratings.team_states(done)).select("team", F.rint("elo").cast("long").alias("elo"))
    details = board.first_seen(games, ["score"]).withColumnRenamed("score", "first_score")
    made = table.join(form, "team", "left").join(states, "team", "left").join(details, "team", "left")
    return made.withColumn("record", contest.record(F.col("wins"), F.col("losses"), F.lit(0))).drop("wins", "losses").orderBy(F.col("points").desc(), "team")


from .catalog_ratings import _elo_cte  # noqa: E402

SQL_TEAM_TABLE = with_views(
    "games_v",
    _elo_cte() + """,
sides AS (SELECT game_id, game_date, season, home_team AS team, home_score > away_score AS won, last_period_type FROM done UNION ALL
  SELECT game_id, game_date, season, away_team, away_score > home_score, last_period_type FROM done),
t AS (SELECT team, COUNT(*) FILTER (WHERE won) AS wins, COUNT(*) FILTER (WHERE NOT won) AS losses FROM sides WHERE season = 20002001 GROUP BY team),
f AS (SELECT team, string_agg(CASE WHEN won THEN 'W' WHEN last_period_type IN ('OT', 'SO') THEN 'O' ELSE 'L' END, ',' ORDER BY r DESC) AS form
  FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY game_date DESC, game_id DESC) AS r FROM sides WHERE season = 20002001) x WHERE r <= 5 GROUP BY team),
l AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY pool ORDER BY k DESC) = 1),
e AS (SELECT p.team, round_even(elo[p.team + 1], 0) AS elo FROM (SELECT DISTINCT pool, home_team AS team FROM done UNION SELECT DISTINCT pool, away_team FROM done) p JOIN l ON l.pool = p.pool),
d AS (SELECT team, score AS first_score FROM (SELECT home_team AS team, home_score AS score, game_date, game_id, 0 AS s FROM games_v
 UNION ALL SELECT away_team, away_score, game_date, game_id, 1 FROM games_v) x QUALIFY row_number() OVER (PARTITION BY team ORDER BY game_date, game_id, s) = 1)
SELECT t.team, 2 * wins AS points, form, CAST(elo AS BIGINT) AS elo, first_score, CAST(wins AS VARCHAR) || '-' || CAST(losses AS VARCHAR) || '-0' AS record
FROM t JOIN f USING (team) JOIN e USING (team) JOIN d USING (team)""",
    recursive=True,
)

def refresh_payload(spark, folder):
    """The delivery of a daily run as rows of sections: predictions for the window, recent results and the scorecard."""
    preds = standin.predictions(spark, folder)
    wanted = board.wanted_games(preds, "2001-06-15", 14)
    made = serving.prediction_columns(F.col("p_home"))
    upcoming = wanted.select(
        F.col("game_id").alias("gameId"), F.col("game_date").cast("string").alias("gameDate"), F.col("home_team").alias("home"), F.col("away_team").alias("away"),
        made["home_odds"].alias("homeOdds"), made["away_odds"].alias("awayOdds"), made["pick"].alias("pick"),
    )
    recent = board.finished_since(standin.games(spark, folder), "2001-05-31", 21)
    home_won = F.col("home_score") > F.col("away_score")
    finished = recent.select(
        F.col("game_id").alias("gameId"), F.col("home_score").alias("homeScore"), F.col("away_score").alias("awayScore"),
        F.when(home_won, F.col("home_team")).otherwise(F.col("away_team")).alias("winner"), F.col("last_period_type").isin("OT", "SO").alias("overtime"),
    )
    graded = preds.filter(contest.is_completed(F.col("game_state")))
    report = scores.season_scorecard(graded).select("season", "games", "accuracy")
    return landing.sections_frame({"upcoming": upcoming, "finished": finished, "report": report})


def _o(p: str) -> str:
    q = f"least(greatest({p}, 0.02::DOUBLE), 1 - 0.02::DOUBLE)"
    return f"CAST(round_even(CASE WHEN {q} >= 0.5 THEN -100 * {q} / (1 - {q}) ELSE 100 * (1 - {q}) / {q} END, 0) AS BIGINT)"


SQL_PAYLOAD = with_views(
    "preds_v",
    f"""{G}, g AS (SELECT * FROM games_v WHERE game_state = 'OFF' AND game_date >= DATE '2001-05-31' - 21)
SELECT 'upcoming' AS section, CAST(to_json({{'gameId': game_id, 'gameDate': CAST(game_date AS VARCHAR), 'home': home_team, 'away': away_team, 'homeOdds': {_o('p_home')},
  'awayOdds': {_o('(1 - p_home)')}, 'pick': CASE WHEN p_home >= 0.5 THEN home_team ELSE away_team END}}) AS VARCHAR) AS document
 FROM preds_v WHERE game_state = 'FUT' AND game_date BETWEEN DATE '2001-06-15' AND DATE '2001-06-29'
UNION ALL SELECT 'finished', CAST(to_json({{'gameId': game_id, 'homeScore': home_score, 'awayScore': away_score, 'winner': CASE WHEN home_score > away_score THEN home_team ELSE away_team END,
  'overtime': last_period_type IN ('OT', 'SO')}}) AS VARCHAR) FROM g
UNION ALL SELECT 'report', CAST(to_json({{'season': season, 'games': games, 'accuracy': accuracy}}) AS VARCHAR)
 FROM (SELECT COALESCE(CAST(season AS VARCHAR), 'ALL') AS season, COUNT(*) AS games, {rnd("100 * avg(CASE WHEN (p_home >= 0.5) = (y = 1) THEN 1 ELSE 0 END)", 1)} AS accuracy FROM graded GROUP BY ROLLUP(season)) r""",
)

# penalties by the same recursion as the penalty query, scores by the one above
from .catalog_live import SQL_PENALTIES  # noqa: E402

_PEN_BODY = SQL_PENALTIES.split("sit AS (", 1)[1].rsplit("\nSELECT game_id, i AS event_index", 1)
_DOC_BODY = SQL_DOC_STATE.split("step AS (", 1)[1].rsplit("\nSELECT o.game_id", 1)[0]
SQL_STATE_ROWS = with_views(
    "plays_v",
    _PLAY_SQL + ",\nsit AS (" + _PEN_BODY[0] + ",\npen AS (SELECT game_id, i AS event_index" + _PEN_BODY[1] + "),\nscr AS ("
    + _DOC_BODY.replace("FROM step s JOIN q", "FROM scr s JOIN q") + f""",
c AS (SELECT game_id, event_id, SUM(CASE WHEN side = 'home' THEN COALESCE(penalty_minutes, 0) ELSE -COALESCE(penalty_minutes, 0) END) {W} AS pmd,
  SUM(CASE WHEN {_SHOT} THEN CASE WHEN side = 'home' THEN 1 ELSE -1 END ELSE 0 END) {W} AS sogd FROM q)
SELECT q.game_id, q.event_id, q.sort_order AS event_index, CAST(20232024 AS BIGINT) AS season, 'HOM' AS home_team, 'AWY' AS away_team, CASE WHEN side = 'home' THEN 'HOM' ELSE 'AWY' END AS event_team,
 side AS event_team_side, CAST(period AS BIGINT) AS period, CASE WHEN period <= 3 THEN 'REG' ELSE 'OT' END AS period_type,
 lpad(CAST(ins // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ins % 60 AS VARCHAR), 2, '0') AS time_in_period, seconds_elapsed, p.home_active_penalties, p.away_active_penalty_seconds,
 s.h AS home_score, s.a AS away_score, CAST(pmd AS BIGINT) AS penalty_minute_diff_home, CAST(sogd AS BIGINT) AS sog_diff_home, CAST(penalty_minutes AS DOUBLE) AS penalty_minutes_event,
 CASE WHEN event_type = 'penalty' THEN 'hooking' END AS reason, CASE WHEN {_SHOT} THEN 100 + q.sort_order % 3 END AS goalie_in_net_id,
 CASE WHEN event_type = 'penalty' THEN q.event_id % 30 END AS drawn_by_player_id, CAST(NULL AS BIGINT) AS target_home_win
FROM q JOIN pen p ON p.game_id = q.game_id AND p.event_index = q.sort_order JOIN scr s ON s.game_id = q.game_id AND s.sort_order = q.sort_order JOIN c ON c.game_id = q.game_id AND c.event_id = q.event_id""",
    recursive=True,
)

QUERIES = {
    "live_state_rows": (live_state_rows, SQL_STATE_ROWS),
    "refresh_payload": (refresh_payload, SQL_PAYLOAD),
    "flatten_schedule": (flatten_schedule, SQL_SCHEDULE),
    "first_schedule_wins": (first_schedule_wins, SQL_FIRST),
    "serving_schedule": (serving_schedule, SQL_SERVING),
    "upcoming_split": (upcoming_split, SQL_UPCOMING),
    "flatten_team_lines": (flatten_team_lines, SQL_TEAM_LINES),
    "flatten_skaters": (flatten_skaters, SQL_SKATER_ROWS),
    "flatten_goalies": (flatten_goalies, SQL_GOALIE_ROWS),
    "document_starters": (document_starters, SQL_DOC_STARTERS),
    "flatten_plays": (flatten_plays, SQL_PLAYS),
    "state_from_documents": (state_from_documents, SQL_DOC_STATE),
    "latest_standings": (latest_standings, SQL_STANDINGS),
    "rosters": (rosters, SQL_ROSTERS),
    "live_snapshot": (live_snapshot, SQL_SNAPSHOT),
    "club_season_stats": (club_season_stats, SQL_CLUBS),
    "active_teams": (active_teams, SQL_ACTIVE),
    "standings_end": (standings_end, SQL_STANDINGS_END),
    "season_history_export": (season_history_export, SQL_EXPORT),
    "hero_summary": (hero_summary, SQL_HERO),
    "team_table": (team_table, SQL_TEAM_TABLE),
}
