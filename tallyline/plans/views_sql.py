"""The stand-in views as SQL text for the independent check, one CTE each."""

from __future__ import annotations

GAMES = """games_v AS (
 SELECT CAST(o_orderkey AS BIGINT) AS game_id, CAST(o_orderdate AS DATE) AS game_date,
        CAST(CASE WHEN month(o_orderdate) >= 8 THEN year(o_orderdate)*10000 + year(o_orderdate) + 1
             ELSE (year(o_orderdate)-1)*10000 + year(o_orderdate) END AS BIGINT) AS season,
        CAST(CASE WHEN month(o_orderdate) IN (5,6) THEN 3 ELSE 2 END AS BIGINT) AS game_type,
        CASE WHEN o_orderdate >= TIMESTAMP '2001-06-01' THEN 'FUT' ELSE 'OFF' END AS game_state,
        CASE WHEN o_orderkey % 4 = 3 THEN 'OT' ELSE 'REG' END AS last_period_type,
        CAST(c_nationkey % 5 AS BIGINT) AS pool, CAST(c_nationkey AS BIGINT) AS home_team,
        CAST((c_nationkey + 5*(1 + o_orderkey % 4)) % 25 AS BIGINT) AS away_team,
        CAST((o_orderkey*31) % 7 + CASE WHEN (o_orderkey*31) % 7 = (o_orderkey*17 + o_custkey) % 7 THEN 1 ELSE 0 END AS BIGINT) AS home_score,
        CAST((o_orderkey*17 + o_custkey) % 7 AS BIGINT) AS away_score
 FROM orders JOIN customer ON o_custkey = c_custkey)"""

PREDS = """preds_v AS (
 SELECT game_id, season, game_date, game_type, game_state, pool, home_team, away_team, home_score, away_score,
        CAST(CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS BIGINT) AS y,
        ((game_id*7919) % 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS p_home,
        ((game_id*6101) % 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS p_logit,
        ((game_id*4409) % 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS p_hgb,
        ((game_id*3571) % 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS elo_prob_home
 FROM games_v)"""

PLAYS = """plays_v AS (
 SELECT user_id AS game_id, event_id, ts, CAST(n AS BIGINT) AS sort_order,
        CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'shot-on-goal' WHEN 'view' THEN 'missed-shot'
                        WHEN 'error' THEN 'penalty' ELSE 'faceoff' END AS event_type,
        CASE WHEN k % 2 = 0 THEN 'home' ELSE 'away' END AS side,
        CASE WHEN k % 10 < 2 THEN '1541' WHEN k % 10 < 4 THEN '1451' ELSE '1551' END AS situation_code,
        CAST((n - 1) * 40 AS BIGINT) AS seconds_elapsed,
        CAST(CASE WHEN event_type = 'error' THEN CASE WHEN k % 5 = 0 THEN 5 ELSE 2 END END AS BIGINT) AS penalty_minutes
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) e)"""

DETAILED = """detailed_v AS (
 SELECT game_id, event_id, sort_order, side, situation_code, seconds_elapsed, penalty_minutes,
        CASE WHEN event_type = 'faceoff' THEN ['hit', 'giveaway', 'takeaway', 'blocked-shot', 'faceoff'][event_id % 5 + 1] ELSE event_type END AS event_type,
        CASE WHEN event_type IN ('goal', 'shot-on-goal') THEN CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 100 + event_id % 3 END END AS goalie_in_net_id,
        CASE WHEN event_type = 'goal' AND event_id % 3 = 0 THEN event_id % 5 END AS home_score_event,
        CASE WHEN event_type = 'goal' AND event_id % 4 < 2 THEN event_id % 3 END AS away_score_event,
        game_id % 1000 * 600 + seconds_elapsed AS fed_second
 FROM plays_v)"""

BOX = """box_v AS (
 SELECT l_orderkey AS game_id, CAST(l_linenumber % 2 AS BIGINT) AS is_home,
        CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shots_for,
        CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS powerplay_goals,
        CAST(SUM(CASE WHEN l_returnflag IN ('R','A') THEN 1 ELSE 0 END) AS BIGINT) AS powerplay_opportunities,
        CAST(SUM(l_linenumber) AS BIGINT) AS penalty_minutes,
        CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (100 * COUNT(*)) AS faceoff_win_pct,
        CAST(SUM(l_suppkey % 5) AS BIGINT) AS blocked_shots, CAST(SUM(l_partkey % 7) AS BIGINT) AS hits,
        CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS giveaways,
        CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS takeaways
 FROM lineitem GROUP BY 1, 2)"""

SKATERS = """skaters_v AS (
 SELECT l_orderkey AS game_id, CAST(l_linenumber % 2 AS BIGINT) AS is_home, l_partkey AS player_id,
        l_suppkey % 3 AS goals, l_partkey % 3 AS assists, l_suppkey % 3 + l_partkey % 3 AS points,
        CAST(l_quantity AS BIGINT) % 8 AS shots, l_partkey % 7 AS hits, l_suppkey % 5 AS blocked_shots,
        CAST(l_quantity AS BIGINT) * 60 + l_partkey % 60 AS toi_seconds
 FROM lineitem)"""

GOALIES = """goalies_v AS (
 SELECT l_orderkey AS game_id, CAST(l_linenumber % 2 AS BIGINT) AS is_home, l_suppkey AS player_id,
        'G' || CAST(l_suppkey AS VARCHAR) AS goalie_name,
        l_partkey % 20 + 20 AS shots_against, l_partkey % 6 AS goals_against,
        CAST((l_partkey % 20 + 20) - (l_partkey % 6) AS DOUBLE) / (l_partkey % 20 + 20) AS save_pct,
        CAST(l_quantity AS BIGINT) * 60 + l_partkey % 60 AS toi_seconds, l_partkey AS line_order
 FROM lineitem WHERE l_returnflag = 'N')"""

PICKS = """picks_v AS (
 SELECT o_custkey AS user_id, o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS made_on,
        CASE WHEN o_orderkey % 3 = 0 THEN 'away' ELSE 'home' END AS pick FROM orders)"""

_ALL = {"games_v": GAMES, "preds_v": PREDS, "plays_v": PLAYS, "detailed_v": DETAILED, "box_v": BOX, "skaters_v": SKATERS, "goalies_v": GOALIES, "picks_v": PICKS}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named views (``games_v`` comes with ``preds_v``) in front of ``body``.

    ``body`` either starts with further CTEs (``name AS (``) or with SELECT.
    """
    wanted = names.split()
    if "preds_v" in wanted and "games_v" not in wanted:
        wanted.insert(0, "games_v")
    ordered = [_ALL[n] for n in _ALL if n in wanted]
    body = body.strip()
    joiner = "\n" if body[:6].upper() == "SELECT" else ",\n"
    if not ordered:
        return ("WITH RECURSIVE " if recursive else "WITH ") + body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ordered) + joiner + body
