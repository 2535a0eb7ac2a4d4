"""Feed documents derived from the sample tables, as JSON text.

Documents are cut so that each stays small: a schedule holds at most 64 games
of a day, a play document at most 256 plays, a box score sums its lines into
twenty skater slots before they are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_key
from ..functions.contest import is_completed
from ..operators.history import eligible, team_games
from . import standin


def _listed(*fields) -> Column:
    """An array of the group's structs in the order of their first field."""
    return F.array_sort(F.collect_list(F.struct(*fields)))


def _text(value: Column) -> Column:
    return F.struct(value.cast("string").alias("default"))


def schedules(spark: SparkSession, folder: str) -> DataFrame:
    """Club schedules of three shapes; every game is in its home and in its away club's schedule."""
    games = standin.games(spark, folder)
    both = games.select("*", F.explode(F.array("home_team", "away_team")).alias("club"))

    def side(s: str) -> Column:
        team = F.col(f"{s}_team").cast("string")
        return F.struct(
            F.col(f"{s}_team").alias("id"), F.concat(F.lit("T"), team).alias("abbrev"), F.col(f"{s}_score").alias("score"),
            F.concat(F.lit("logo/"), team).alias("logo"), _text(F.concat(F.lit("Name"), team)).alias("commonName"),
            _text(F.concat(F.lit("City"), team)).alias("placeName"),
        )

    day = F.col("game_date").cast("string")
    game = [
        F.col("game_id").alias("id"), F.col("season"), F.col("game_type").alias("gameType"), day.alias("gameDate"),
        F.concat(day, F.lit("T23:00:00Z")).alias("startTimeUTC"), _text(F.concat(F.lit("Arena "), F.col("club").cast("string"))).alias("venue"),
        F.col("game_state").alias("gameState"), side("home").alias("homeTeam"), side("away").alias("awayTeam"),
        F.struct(F.col("last_period_type").alias("lastPeriodType")).alias("gameOutcome"),
    ]
    grouped = both.groupBy("club", day.alias("day"), F.floor(F.col("game_id") / 64).alias("part")).agg(_listed(*game).alias("games"))
    shape, listed = F.col("club") % 3, F.col("games")
    days = F.array(F.struct(listed.alias("games")))
    return grouped.select(
        "club", "day", "part",
        F.to_json(F.struct(F.when(shape == 0, listed).alias("games"), F.when(shape == 1, days).alias("gameWeek"), F.when(shape == 2, days).alias("gamesByDate"))).alias("text"),
    )


def box_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Game columns with a box score and rail statistics as JSON text; two games in three have rail statistics."""
    lines = standin.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"
    )
    side = F.when(F.col("l_linenumber") % 2 == 1, "home").otherwise("away").alias("side")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    slots = lines.groupBy(F.col("l_orderkey").alias("game_id"), side, (part % 20).alias("slot")).agg(
        F.sum(supplier % 3).alias("goals"), F.sum(part % 3).alias("assists"), F.sum(part % 7).alias("hits"),
        F.sum(supplier % 5).alias("blockedShots"), F.sum(F.col("l_linenumber").cast("long")).alias("pim"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("powerPlayGoals"),
        F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("giveaways"),
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("takeaways"),
        F.sum(F.col("l_quantity").cast("long")).alias("sog"), F.max("l_discount").alias("faceoffWinningPctg"),
    )
    toi = F.format_string("%02d:%02d", F.col("sog") % 60, F.col("hits") % 60)
    player = F.struct(
        F.col("slot").alias("playerId"), _text(F.concat(F.lit("P"), F.col("slot").cast("string"))).alias("name"), F.lit("C").alias("position"),
        "goals", "assists", (F.col("goals") + F.col("assists")).alias("points"), "sog", "hits", "blockedShots", "pim",
        (F.col("goals") - F.col("assists")).alias("plusMinus"), toi.alias("toi"), "powerPlayGoals", "giveaways", "takeaways", "faceoffWinningPctg",
    )
    keyed = F.when(F.col("side") == "home", 1).otherwise(0)
    totals = ("sog", "pim", "hits", "powerPlayGoals")
    aggs = []
    for s, flag in (("home", 1), ("away", 0)):
        own = keyed == flag
        for group, cond in (("forwards", F.col("slot") < 12), ("defense", F.col("slot") >= 12)):
            aggs.append(F.array_sort(F.collect_list(F.when(own & cond, player))).alias(f"{s}_{group}"))
        aggs += [F.coalesce(F.sum(F.when(own, F.col(t))), F.lit(0)).alias(f"{s}_{t}") for t in totals]
    per_game = slots.groupBy("game_id").agg(*aggs)

    goalies = lines.filter(F.col("l_returnflag") == "N").groupBy(
        F.col("l_orderkey").alias("game_id"), side, (supplier % 2).alias("slot")
    ).agg(F.sum(part % 30 + 20).alias("shots"), F.sum(part % 6).alias("against"), F.sum(F.col("l_quantity").cast("long")).alias("minutes"))
    share = F.rint((F.col("shots") - F.col("against")) / F.col("shots") * 1000) / 1000
    goalie = F.struct(
        F.col("slot").alias("playerId"), _text(F.concat(F.lit("G"), F.col("slot").cast("string"))).alias("name"),
        F.col("shots").alias("shotsAgainst"), (F.col("shots") - F.col("against")).alias("saves"), F.col("against").alias("goalsAgainst"),
        F.when(F.col("game_id") % 2 == 0, share).otherwise(F.lit(0.0)).alias("savePctg"), share.alias("savePct"),
        F.lit("W").alias("decision"), F.format_string("%02d:00", F.col("minutes")).alias("toi"),
    )
    per_game_goalies = goalies.groupBy("game_id").agg(
        *[F.array_sort(F.collect_list(F.when(keyed == flag, goalie))).alias(f"{s}_goalies") for s, flag in (("home", 1), ("away", 0))]
    )
    games = standin.games(spark, folder).select("game_id", "season", "game_date", "home_team", "away_team", "home_score", "away_score")
    joined = games.join(per_game, "game_id").join(per_game_goalies, "game_id", "left")

    def team(s: str) -> Column:
        code = F.concat(F.lit("T"), F.col(f"{s}_team").cast("string"))
        return F.struct(F.when(F.col("game_id") % 5 > 0, code).alias("abbrev"), F.col(f"{s}_score").alias("score"), F.col(f"{s}_sog").alias("sog"))

    groups = F.struct(
        *[F.struct(F.col(f"{s}_forwards").alias("forwards"), F.col(f"{s}_defense").alias("defense"), F.col(f"{s}_goalies").alias("goalies")).alias(f"{s}Team") for s in ("home", "away")]
    )
    box = F.to_json(F.struct(team("home").alias("homeTeam"), team("away").alias("awayTeam"), groups.alias("playerByGameStats")))

    def stat(category: str, home: Column, away: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), home.cast("string").alias("homeValue"), away.cast("string").alias("awayValue"))

    def play(s: str) -> Column:
        return F.concat(F.col(f"{s}_powerPlayGoals").cast("string"), F.lit("/"), (F.col(f"{s}_powerPlayGoals") + 2).cast("string"))

    # hits come twice; the first entry is wrong and must lose
    stats = F.array(
        stat("sog", F.col("home_sog") + 1, F.col("away_sog") + 1), stat("powerPlay", play("home"), play("away")),
        stat("hits", F.lit(-1), F.lit(-1)), stat("hits", F.col("home_hits") + 2, F.col("away_hits") + 2),
    )
    rail = F.when(F.col("game_id") % 3 > 0, F.to_json(F.struct(stats.alias("teamGameStats"))))
    code = lambda s: F.concat(F.lit("T"), F.col(f"{s}_team").cast("string")).alias(f"{s}_team")
    return joined.select("game_id", "season", F.col("game_date").cast("string").alias("game_date"), code("home"), code("away"), box.alias("box"), rail.alias("rail"))


def play_by_play(spark: SparkSession, folder: str) -> DataFrame:
    """Play documents per game in parts of at most 256 plays. Some goals state the score."""
    plays = standin.plays(spark, folder)
    n, kind = F.col("sort_order"), F.col("event_type")
    period = F.least(F.floor(F.col("seconds_elapsed") / 1200) + 1, F.lit(4))
    period = F.when(F.col("seconds_elapsed") >= 3600, 4 + F.floor((F.col("seconds_elapsed") - 3600) / 300)).otherwise(period)
    start = F.when(period <= 3, (period - 1) * 1200).otherwise(3600 + (period - 4) * 300)
    inside = F.col("seconds_elapsed") - start
    shot = kind.isin("goal", "shot-on-goal")
    stated = (kind == "goal") & (n % 4 == 0)
    details = F.to_json(
        F.struct(
            F.when(shot, F.col("event_id") % 50).alias("shootingPlayerId"),
            F.when(F.col("side") == "home", 1).otherwise(2).alias("eventOwnerTeamId"),
            F.when(shot, 100 + n % 3).alias("goalieInNetId"),
            F.when(kind == "penalty", F.col("event_id") % 40).alias("committedByPlayerId"),
            F.when(kind == "penalty", F.col("event_id") % 30).alias("drawnByPlayerId"),
            F.when(kind == "faceoff", F.col("event_id") % 20).alias("winningPlayerId"),
            F.col("penalty_minutes").alias("duration"),
            (n % 90).alias("xCoord"),
            F.when(kind == "penalty", "hooking").alias("descKey"),
            F.when(stated, F.floor(n / 8)).alias("homeScore"),
            F.when(stated, F.floor(n / 12)).alias("awayScore"),
        )
    )
    play = F.struct(
        n.alias("sortOrder"), F.col("event_id").alias("eventId"), kind.alias("typeDescKey"),
        F.struct(period.alias("number"), F.when(period <= 3, "REG").otherwise("OT").alias("periodType")).alias("periodDescriptor"),
        F.format_string("%02d:%02d", F.floor(inside / 60), inside % 60).alias("timeInPeriod"), F.col("situation_code").alias("situationCode"),
        details.alias("details"),
    )
    grouped = plays.groupBy("game_id", F.floor(n / 256).alias("part")).agg(F.array_sort(F.collect_list(play)).alias("plays"))
    # details stay JSON text here and are put into the document as objects
    doc = F.struct(
        F.col("game_id").alias("id"), F.lit(20232024).alias("season"), F.lit(2).alias("gameType"), F.lit("2024-01-01").alias("gameDate"),
        F.lit("OFF").alias("gameState"), F.struct(F.lit(1).alias("id"), F.lit("HOM").alias("abbrev")).alias("homeTeam"),
        F.struct(F.lit(2).alias("id"), F.lit("AWY").alias("abbrev")).alias("awayTeam"),
        F.transform("plays", lambda p: p.withField("details", F.parse_json(p["details"]))).alias("plays"),
    )
    return grouped.select("game_id", "part", F.to_json(doc).alias("text"))


def standings(spark: SparkSession, folder: str) -> DataFrame:
    """A standings snapshot per season and month with the month's record of each team."""
    rows = team_games(eligible(standin.games(spark, folder)))
    late = F.col("last_period_type") == "OT"
    record = rows.groupBy("season", month_key(F.col("game_date")).alias("month"), "team").agg(
        F.sum(F.col("win").cast("long")).alias("wins"),
        F.sum(F.when((F.col("win") == 0) & ~late, 1).otherwise(0)).alias("losses"),
        F.sum(F.when((F.col("win") == 0) & late, 1).otherwise(0)).alias("otLosses"),
    )
    team = F.col("team").cast("string")
    points = 2 * F.col("wins") + F.col("otLosses")
    entry = F.struct(
        F.col("team"), F.when(F.col("team") % 2 == 0, F.col("season")).alias("seasonId"), _text(F.concat(F.lit("T"), team)).alias("teamAbbrev"),
        _text(F.concat(F.lit("City Name"), team)).alias("teamName"), "wins", "losses", "otLosses", points.alias("points"),
        (F.col("wins") + F.col("losses") + F.col("otLosses")).alias("gamesPlayed"), F.lit("W").alias("streakCode"), (F.col("wins") % 5).alias("streakCount"),
    )
    docs = record.groupBy("season", "month", F.floor(F.col("team") / 64).alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("standings"))
    return docs.select("season", F.concat("month", F.lit("-28")).alias("snapshot_date"), F.to_json(F.struct("standings")).alias("text"))


def rosters(spark: SparkSession, folder: str) -> DataFrame:
    """Rosters of the nations: their customers in three groups, in parts of ids."""
    c = standin.table(spark, folder, "customer")
    key = F.col("c_custkey")
    player = F.struct(
        key.alias("id"), _text(F.lit("First")).alias("firstName"), _text(F.split("c_name", "#")[1]).alias("lastName"),
        F.substring("c_mktsegment", 1, 1).alias("positionCode"), (key % 99).alias("sweaterNumber"),
    )
    groups = [
        F.array_sort(F.collect_list(F.when(key % 3 == i, player))).alias(g) for i, g in enumerate(("forwards", "defensemen", "goalies"))
    ]
    docs = c.groupBy(F.col("c_nationkey").cast("long").alias("team"), F.floor(key / 1024).alias("part")).agg(*groups)
    return docs.select("team", F.to_json(F.struct("forwards", "defensemen", "goalies")).alias("text"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Two live snapshots: the older one lists all open games, the newer one those dated up to its day."""
    games = standin.games(spark, folder).filter(~is_completed(F.col("game_state")))
    both = games.select("*", F.explode(F.array(F.lit("20010601T100000Z"), F.lit("20010601T110000Z"))).alias("snapshot_id"))
    kept = both.filter((F.col("snapshot_id") == "20010601T100000Z") | (F.col("game_date") <= F.lit("2001-07-01").cast("date")))
    state = F.when(F.col("snapshot_id") == "20010601T100000Z", "PRE").otherwise("LIVE")
    side = lambda s: F.struct(F.concat(F.lit("T"), F.col(f"{s}_team").cast("string")).alias("abbrev")).alias(f"{s}Team")
    game = F.struct(F.col("game_id").alias("id"), F.col("game_date").cast("string").alias("gameDate"), state.alias("gameState"), side("home"), side("away"))
    docs = kept.groupBy("snapshot_id", F.floor(F.col("game_id") / 64).alias("part")).agg(F.array_sort(F.collect_list(game)).alias("games"))
    return docs.select("snapshot_id", "part", F.to_json(F.struct("games")).alias("text"))


def shift_charts(spark: SparkSession, folder: str) -> DataFrame:
    """Shift documents per game; which fields an entry has differs from line to line, and a start may be whole or not."""
    lines = standin.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    start = F.when(F.col("l_orderkey") % 7 == 0, (F.col("l_suppkey") / 4).cast("string")).otherwise(F.col("l_suppkey").cast("string"))
    # numbers are written as text of their own, so that whole ones carry no decimal point
    entry = F.struct(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("playerId"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity").cast("long")).alias("duration"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("eventDescription"), F.parse_json(start).alias("startTime"),
        F.lit(-1).alias("season"),
    )
    docs = lines.groupBy(F.col("l_orderkey").alias("game_id")).agg(F.collect_list(F.to_json(entry)).alias("entries"))
    text = F.concat(F.lit('{"data":['), F.array_join("entries", ","), F.lit("]}"))
    seasons = standin.games(spark, folder).select("game_id", "season")
    return docs.join(seasons, "game_id").select("game_id", "season", text.alias("text"))


def series_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Series documents of a pair and season in parts of ids, filed under their first game; every other one carries opaque information."""
    games = standin.games(spark, folder)
    done = is_completed(F.col("game_state"))

    def side(s: str) -> Column:
        return F.struct(F.concat(F.lit("T"), F.col(f"{s}_team").cast("string")).alias("abbrev"), F.when(done, F.col(f"{s}_score")).alias("score")).alias(f"{s}Team")

    game = F.struct(
        F.col("game_id").alias("id"), F.col("game_date").cast("string").alias("gameDate"), F.col("game_state").alias("gameState"), side("home"), side("away")
    )
    pair = (F.least("home_team", "away_team").alias("a"), F.greatest("home_team", "away_team").alias("b"))
    docs = games.groupBy(*pair, "season", F.floor(F.col("game_id") / 64).alias("part")).agg(
        F.min("game_id").alias("game_id"), F.count(F.lit(1)).alias("meetings"), F.collect_list(game).alias("seasonSeries")
    )
    info = F.when(F.col("game_id") % 2 == 0, F.struct("meetings")).alias("gameInfo")
    return docs.select("game_id", "season", F.to_json(F.struct("seasonSeries", info)).alias("text"))
