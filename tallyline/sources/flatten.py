"""Flattening of the feed's documents into tables.

All functions take DataFrames of parsed documents (``from_json`` or
``spark.read.json`` with the schemas below) and stay in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import clock_seconds, game_seconds, iso_date
from ..functions.contest import default_text, event_description, first_reason, fraction_part, is_completed
from ..functions.numbers import first_number
from ..operators.store import keep_first, keep_last

# fixed values: shapes of the documents
_TEXT = "map<string,string>"
_SIDE = f"struct<id:bigint,abbrev:string,score:bigint,sog:bigint,logo:string,commonName:{_TEXT},placeName:{_TEXT}>"
GAME = (
    f"struct<id:bigint,season:bigint,gameType:bigint,gameDate:string,startTimeUTC:string,venue:{_TEXT},gameState:string,"
    f"homeTeam:{_SIDE},awayTeam:{_SIDE},gameOutcome:struct<lastPeriodType:string>>"
)
SCHEDULE = f"games array<{GAME}>, gameWeek array<struct<games:array<{GAME}>>>, gamesByDate array<struct<games:array<{GAME}>>>"
_SKATER = (
    f"struct<playerId:bigint,name:{_TEXT},position:string,goals:bigint,assists:bigint,points:bigint,sog:bigint,hits:bigint,"
    "blockedShots:bigint,pim:bigint,plusMinus:bigint,toi:string,powerPlayGoals:bigint,giveaways:bigint,takeaways:bigint,"
    "faceoffWinningPctg:double>"
)
_GOALIE = (
    f"struct<playerId:bigint,name:{_TEXT},shotsAgainst:bigint,saves:bigint,goalsAgainst:bigint,savePctg:double,savePct:double,"
    "decision:string,toi:string>"
)
_GROUPS = f"struct<forwards:array<{_SKATER}>,defense:array<{_SKATER}>,goalies:array<{_GOALIE}>>"
BOXSCORE = f"homeTeam {_SIDE}, awayTeam {_SIDE}, playerByGameStats struct<homeTeam:{_GROUPS},awayTeam:{_GROUPS}>"
RAIL = (
    "teamGameStats array<struct<category:string,homeValue:string,awayValue:string>>, "
    f"seasonSeries array<{GAME}>, gameInfo string"
)
_PLAY = (
    "struct<eventId:bigint,sortOrder:bigint,typeDescKey:string,periodDescriptor:struct<number:bigint,periodType:string>,"
    "timeInPeriod:string,timeRemaining:string,situationCode:string,homeTeamDefendingSide:string,details:string>"
)
PLAY_BY_PLAY = (
    f"id bigint, season bigint, gameType bigint, gameDate string, startTimeUTC string, venue {_TEXT}, gameState string, "
    f"maxPeriods bigint, homeTeam {_SIDE}, awayTeam {_SIDE}, plays array<{_PLAY}>"
)
DETAILS = (
    "eventOwnerTeamId bigint, winningPlayerId bigint, losingPlayerId bigint, shootingPlayerId bigint, blockingPlayerId bigint, "
    "hittingPlayerId bigint, hitteePlayerId bigint, scoringPlayerId bigint, assist1PlayerId bigint, assist2PlayerId bigint, "
    "goalieInNetId bigint, committedByPlayerId bigint, drawnByPlayerId bigint, servedByPlayerId bigint, xCoord double, yCoord double, "
    "zoneCode string, strength string, shotType string, typeCode string, duration double, reason string, secondaryReason string, "
    "descKey string, homeScore bigint, awayScore bigint, homeSOG bigint, awaySOG bigint"
)


def at(value: Column, path: str) -> Column:
    """A nested field by its dotted path."""
    for name in path.split("."):
        value = value[name]
    return value


def games_of(docs: DataFrame, order: list[str]) -> DataFrame:
    """One row ``g`` per game of a schedule document of any shape: ``games``, else weeks and dates."""
    days = lambda c: F.flatten(F.transform(F.coalesce(c, F.array()), lambda d: F.coalesce(d["games"], F.array())))
    nested = F.concat(days(F.col("gameWeek")), days(F.col("gamesByDate")))
    return docs.select(*order, F.posexplode(F.coalesce(F.col("games"), nested)).alias("at", "g")).filter(F.col("g.id").isNotNull())


def flatten_game(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The games table; the result is known only once the game is completed with both scores."""
    g = F.col("g")
    known = is_completed(g["gameState"]) & at(g, "homeTeam.score").isNotNull() & at(g, "awayTeam.score").isNotNull()
    return df.select(
        *carry,
        g["id"].alias("game_id"),
        g["season"].alias("season"),
        g["gameType"].alias("game_type"),
        g["gameDate"].alias("game_date"),
        default_text(g["venue"]).alias("venue"),
        at(g, "homeTeam.abbrev").alias("home_team"),
        at(g, "awayTeam.abbrev").alias("away_team"),
        at(g, "homeTeam.score").alias("home_score"),
        at(g, "awayTeam.score").alias("away_score"),
        F.when(known, (at(g, "homeTeam.score") > at(g, "awayTeam.score")).cast("long")).alias("home_win"),
        g["gameState"].alias("game_state"),
        g["startTimeUTC"].alias("start_time_utc"),
    )


def flatten_serving_game(df: DataFrame) -> DataFrame:
    """Games with names and logos; scores are null unless the game is finished, whatever the feed carries."""
    g = F.col("g")
    text = lambda c: F.coalesce(c, F.lit(""))
    finished = is_completed(g["gameState"])
    names = {}
    for s in ("home", "away"):
        team = f"{s}Team"
        names[f"{s}_logo"] = text(at(g, f"{team}.logo"))
        names[f"{s}_name"] = text(at(g, f"{team}.commonName")["default"])
        names[f"{s}_city"] = text(at(g, f"{team}.placeName")["default"])
    return df.select(
        g["id"].alias("game_id"),
        g["season"].alias("season"),
        g["gameType"].alias("game_type"),
        iso_date(g["gameDate"]).alias("game_date"),
        text(g["startTimeUTC"]).alias("start_time_utc"),
        text(g["venue"]["default"]).alias("venue"),
        at(g, "homeTeam.abbrev").alias("home_team"),
        at(g, "awayTeam.abbrev").alias("away_team"),
        *[c.alias(n) for n, c in names.items()],
        F.when(finished, at(g, "homeTeam.score")).alias("home_score"),
        F.when(finished, at(g, "awayTeam.score")).alias("away_score"),
        text(at(g, "gameOutcome.lastPeriodType")).alias("last_period_type"),
        F.coalesce(g["gameState"], F.lit("FUT")).alias("state"),
        finished.alias("finished"),
    )


def schedule_table(docs: DataFrame, order: list[str], last_wins: bool = True) -> DataFrame:
    """The games table from schedule documents: one row per id, the last (or first) document wins."""
    flat = flatten_game(games_of(docs, order).withColumn("_at", F.struct(*order, "at")), ("_at",))
    keep = keep_last if last_wins else keep_first
    return keep(flat, ["game_id"], ["_at"]).drop("_at")


def upcoming(games: DataFrame) -> DataFrame:
    """Games not completed; an unknown state counts as upcoming."""
    return games.filter(~is_completed(F.col("game_state"))).select(
        "game_id", "game_date", "start_time_utc", "home_team", "away_team", "venue", "game_state"
    )


# ---- box scores ------------------------------------------------------------------------------------------------


# fixed values: categories of the rail statistics that count, and the skaters' numbers that are added up
_RAIL_CATEGORIES = ("sog", "powerPlay", "pim", "faceoffWinningPctg", "blockedShots", "hits", "giveaways", "takeaways")
_SUMMED = ("powerPlayGoals", "pim", "blockedShots", "hits", "giveaways", "takeaways")


def _rail_entry(category: str) -> Column:
    """The entry of a category in the rail statistics; the last of repeated entries counts."""
    return F.try_element_at(F.filter("teamGameStats", lambda s: s["category"] == category), F.lit(-1))


def _sides() -> list[tuple[str, str, int]]:
    return [("home", "away", 1), ("away", "home", 0)]


def _skaters(side: str) -> Column:
    groups = F.col(f"playerByGameStats.{side}Team")
    return F.concat(F.coalesce(groups["forwards"], F.array()), F.coalesce(groups["defense"], F.array()))


def _totals(players: Column) -> Column:
    """Sums of the skaters' numbers, and sum and number of the face-off shares above 0, in one pass over them."""
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in _SUMMED], F.lit(0.0).alias("share"), F.lit(0).cast("long").alias("shares"))

    def add(acc: Column, p: Column) -> Column:
        share = p["faceoffWinningPctg"]
        return F.struct(
            *[(acc[n] + F.coalesce(p[n], F.lit(0))).alias(n) for n in _SUMMED],
            F.when(share > 0, acc["share"] + share).otherwise(acc["share"]).alias("share"),
            F.when(share > 0, acc["shares"] + 1).otherwise(acc["shares"]).alias("shares"),
        )

    return F.aggregate(players, start, add)


def team_rows(box: DataFrame) -> DataFrame:
    """Two team lines per box score: the rail's value where there is one, else what the skaters add up to.

    ``box`` has game columns (game_id, season, game_date, home_team, away_team),
    the box score and the rail statistics. Both are gone through once, in a
    projection of their own: a generator would evaluate every mention anew.
    """

    def line(own: str, other: str, is_home: int) -> Column:
        rail = lambda c, s=own: F.col(f"_r_{c}")[f"{s}Value"]
        summed = lambda c: F.col(f"_t_{own}")[c]
        mean = F.try_divide(summed("share"), summed("shares").cast("double"))
        number = lambda *v: first_number(*[x.try_cast("double") if i == 0 else x for i, x in enumerate(v)])
        return F.struct(
            F.coalesce(F.col(f"{own}Team.abbrev"), F.col(f"{own}_team")).alias("team"),
            F.coalesce(F.col(f"{other}Team.abbrev"), F.col(f"{other}_team")).alias("opponent"),
            F.lit(is_home).cast("long").alias("is_home"),
            F.col(f"{own}Team.score").alias("goals_for"),
            F.col(f"{other}Team.score").alias("goals_against"),
            number(rail("sog"), F.col(f"{own}Team.sog")).alias("shots_for"),
            number(rail("sog", other), F.col(f"{other}Team.sog")).alias("shots_against"),
            first_number(fraction_part(rail("powerPlay"), 0), summed("powerPlayGoals")).alias("powerplay_goals"),
            fraction_part(rail("powerPlay"), 1).alias("powerplay_opportunities"),
            number(rail("pim"), summed("pim")).alias("penalty_minutes"),
            number(rail("faceoffWinningPctg"), mean).alias("faceoff_win_pct"),
            number(rail("blockedShots"), summed("blockedShots")).alias("blocked_shots"),
            number(rail("hits"), summed("hits")).alias("hits"),
            number(rail("giveaways"), summed("giveaways")).alias("giveaways"),
            number(rail("takeaways"), summed("takeaways")).alias("takeaways"),
        )

    read = box.select(
        "*", *[_rail_entry(c).alias(f"_r_{c}") for c in _RAIL_CATEGORIES], *[_totals(_skaters(s)).alias(f"_t_{s}") for s, _, _ in _sides()]
    )
    made = read.select("game_id", "season", "game_date", *[line(*s).alias(f"_{s[0]}") for s in _sides()])
    lines = F.explode(F.array(*[f"_{s}" for s, _, _ in _sides()])).alias("t")
    return made.select("game_id", "season", "game_date", lines).select("game_id", "season", "game_date", "t.*")


def _players(box: DataFrame, players, out: str) -> DataFrame:
    def side(own: str, other: str, is_home: int) -> Column:
        return F.struct(
            F.coalesce(F.col(f"{own}Team.abbrev"), F.col(f"{own}_team")).alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.lit(is_home).cast("long").alias("is_home"),
            players(own).alias("players"),
        )

    rows = box.select("game_id", "season", "game_date", F.explode(F.array(*[side(*s) for s in _sides()])).alias("s"))
    return rows.select("game_id", "season", "game_date", "s.team", "s.opponent", "s.is_home", F.posexplode("s.players").alias("line", out))


def skater_rows(box: DataFrame) -> DataFrame:
    """One row per skater, forwards before defense."""
    p = F.col("p")
    return _players(box, _skaters, "p").select(
        "game_id", "season", "game_date", "team", "opponent",
        p["playerId"].alias("player_id"), default_text(p["name"]).alias("player_name"), p["position"].alias("position"),
        p["goals"].alias("goals"), p["assists"].alias("assists"), p["points"].alias("points"), p["sog"].alias("shots"),
        p["hits"].alias("hits"), p["blockedShots"].alias("blocked_shots"), p["pim"].alias("pim"),
        p["plusMinus"].alias("plus_minus"), p["toi"].alias("time_on_ice"),
    )


def goalie_rows(box: DataFrame) -> DataFrame:
    """One row per goalie; a save share of 0 counts as not given. ``line`` keeps the listed order."""
    p = F.col("p")
    goalies = lambda s: F.coalesce(F.col(f"playerByGameStats.{s}Team.goalies"), F.array())
    return _players(box, goalies, "p").select(
        "game_id", "season", "game_date", "team", "opponent",
        p["playerId"].alias("player_id"), default_text(p["name"]).alias("goalie_name"),
        p["shotsAgainst"].alias("shots_against"), p["saves"].alias("saves"), p["goalsAgainst"].alias("goals_against"),
        F.coalesce(F.nullif(p["savePctg"], F.lit(0.0)), p["savePct"]).alias("save_pct"),
        p["decision"].alias("decision"), p["toi"].alias("time_on_ice"), F.col("line").cast("long").alias("line"),
    )


def game_starters(box: DataFrame) -> DataFrame:
    """Starting goalie per side: most time on ice, the first listed on a tie, an unreadable clock counting as none."""

    def best(side: str) -> Column:
        listed = F.coalesce(F.col(f"playerByGameStats.{side}Team.goalies"), F.array())
        keyed = F.transform(
            listed, lambda g, i: F.struct(F.coalesce(clock_seconds(g["toi"]), F.lit(0)).alias("t"), (-i).alias("i"), g["playerId"].alias("id"))
        )
        return F.array_max(keyed)["id"]

    return box.select("game_id", best("home").alias("home_starter"), best("away").alias("away_starter"))


def shift_rows(docs: DataFrame) -> DataFrame:
    """Shift entries with the ids of their game, which win over fields of the same name; entries are structs of any shape in ``data``."""
    fields = [f.name for f in docs.schema["data"].dataType.elementType.fields if f.name.lower() not in ("game_id", "season")]
    return docs.select("game_id", "season", F.explode("data").alias("d")).select(*[F.col("d")[f].alias(f) for f in fields], "game_id", "season")


def season_series_rows(docs: DataFrame) -> DataFrame:
    """Meetings of the season, plus one row with the opaque game information where present."""
    g = F.col("g")
    meetings = docs.select("game_id", "season", F.explode("seasonSeries").alias("g")).select(
        "game_id", "season", g["id"].alias("matchup_game_id"), g["gameDate"].alias("matchup_game_date"),
        at(g, "awayTeam.abbrev").alias("away_team"), at(g, "homeTeam.abbrev").alias("home_team"),
        at(g, "awayTeam.score").alias("away_score"), at(g, "homeTeam.score").alias("home_score"), g["gameState"].alias("game_state"),
    )
    info = docs.filter(F.col("gameInfo").isNotNull()).select(
        "game_id", "season", F.lit(None).cast("long").alias("matchup_game_id"), F.col("gameInfo").alias("game_info")
    )
    return meetings.unionByName(info, allowMissingColumns=True)


# ---- plays -----------------------------------------------------------------------------------------------------


def _player_ids(details: Column) -> Column:
    """The first two player ids in the order of their keys; nested players count after the flat ones."""
    flat = F.filter(F.map_entries(F.from_json(details, "map<string,string>")), lambda e: e["key"].endswith("PlayerId") & e["value"].isNotNull())
    ids = F.transform(flat, lambda e: e["value"])
    nested = F.array(*[F.get_json_object(details, f"$.{k}.playerId") for k in ("committedByPlayer", "drawnBy")])
    both = F.concat(F.coalesce(ids, F.array().cast("array<string>")), F.filter(nested, lambda v: v.isNotNull()))
    return F.slice(both, 1, 2)


def play_rows(docs: DataFrame) -> DataFrame:
    """One row per play with the columns of the play-by-play table."""
    exploded = docs.select(
        F.col("id").alias("game_id"), "season", F.col("gameType").alias("game_type"), F.col("gameDate").alias("game_date"),
        "homeTeam", "awayTeam", F.explode("plays").alias("p"),
    )
    rows = exploded.withColumns({"d": F.from_json("p.details", DETAILS), "ids": _player_ids(F.col("p.details"))})
    p, d = F.col("p"), F.col("d")
    owner = d["eventOwnerTeamId"]
    of_home, of_away = owner == F.col("homeTeam.id"), owner == F.col("awayTeam.id")
    period, clock = at(p, "periodDescriptor.number"), p["timeInPeriod"]
    columns: dict[str, Column] = {
        "event_id": p["eventId"],
        "sort_order": p["sortOrder"],
        "period": period,
        "period_type": at(p, "periodDescriptor.periodType"),
        "period_time": clock,
        "time_remaining": p["timeRemaining"],
        "seconds_elapsed": game_seconds(period, clock),
        "period_seconds_elapsed": clock_seconds(clock),
        "event_type": p["typeDescKey"],
        "team": F.when(of_home, F.col("homeTeam.abbrev")).when(of_away, F.col("awayTeam.abbrev")),
        "team_id": owner,
        "team_side": F.when(of_home, F.lit("home")).when(of_away, F.lit("away")),
        "player_1": F.get("ids", F.lit(0)).try_cast("bigint"),
        "player_2": F.get("ids", F.lit(1)).try_cast("bigint"),
    }
    # fixed values: player columns named after their detail key
    for name in (
        "winningPlayerId", "losingPlayerId", "shootingPlayerId", "blockingPlayerId", "hittingPlayerId", "hitteePlayerId",
        "scoringPlayerId", "assist1PlayerId", "assist2PlayerId", "goalieInNetId", "committedByPlayerId", "drawnByPlayerId", "servedByPlayerId",
    ):
        columns[_snake(name)] = d[name]
    columns |= {
        "x_coord": d["xCoord"],
        "y_coord": d["yCoord"],
        "zone": d["zoneCode"],
        "strength": F.coalesce(F.nullif(d["strength"], F.lit("")), p["situationCode"]),
        "situation_code": p["situationCode"],
        "home_team_defending_side": p["homeTeamDefendingSide"],
        "shot_type": d["shotType"],
        "penalty_type": d["typeCode"],
        "penalty_minutes": d["duration"],
        "reason": first_reason(d["reason"], d["secondaryReason"], d["descKey"]),
        "home_score": d["homeScore"],
        "away_score": d["awayScore"],
        "home_sog": d["homeSOG"],
        "away_sog": d["awaySOG"],
        "result": p["typeDescKey"],
        "description": event_description(d["descKey"], p["typeDescKey"], p["eventId"]),
        # a variant keeps its keys sorted, so its text is canonical
        "raw_details_json": F.to_json(F.try_parse_json(F.nullif(p["details"], F.lit("{}")))),
    }
    return rows.select("game_id", "season", "game_type", "game_date", *[c.alias(n) for n, c in columns.items()])


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def live_events(plays: DataFrame) -> DataFrame:
    """Play rows in the shape the in-game state takes; the event's own details ride along."""
    return plays.select(
        "game_id", "event_id", "sort_order", "event_type", F.col("team_side").alias("side"), "situation_code",
        game_seconds(F.col("period"), F.col("period_time"), live=True).alias("seconds_elapsed"), "penalty_minutes",
        "goalie_in_net_id", F.col("home_score").alias("home_score_event"), F.col("away_score").alias("away_score_event"),
        F.col("team").alias("event_team"), F.col("team_side").alias("event_team_side"), "period", "period_type",
        F.col("period_time").alias("time_in_period"), "time_remaining", "x_coord", "y_coord", F.col("zone").alias("zone_code"), "shot_type",
        "penalty_type", F.col("penalty_minutes").alias("penalty_minutes_event"), "reason", "shooting_player_id", "scoring_player_id",
        "committed_by_player_id", "drawn_by_player_id",
    )


def game_context(docs: DataFrame) -> DataFrame:
    """One row per game of play documents: ids, place, teams, final scores and the periods it may have."""
    rows = docs.select(
        F.col("id").alias("game_id"), "season", F.col("gameType").alias("game_type"), F.col("gameDate").alias("game_date"),
        F.col("startTimeUTC").alias("start_time_utc"), default_text(F.col("venue")).alias("venue"), F.col("gameState").alias("game_state"),
        F.col("homeTeam.abbrev").alias("home_team"), F.col("awayTeam.abbrev").alias("away_team"),
        F.col("homeTeam.score").cast("double").alias("home_final_score"), F.col("awayTeam.score").cast("double").alias("away_final_score"),
        F.coalesce("maxPeriods", F.lit(5)).alias("max_periods"),
    )
    return keep_last(rows, ["game_id"], ["game_date"])


# ---- directories, rosters, standings, season statistics --------------------------------------------------------


def roster_rows(docs: DataFrame) -> DataFrame:
    """Players of three position groups per team; ``docs`` has ``team`` and the group arrays."""
    groups = F.array(*[F.struct(F.lit(g).alias("group"), F.coalesce(F.col(g), F.array()).alias("players")) for g in ("forwards", "defensemen", "goalies")])
    rows = docs.select("team", F.explode(groups).alias("s")).select("team", "s.group", F.explode("s.players").alias("p"))
    p = F.col("p")
    full = F.trim(F.concat(F.coalesce(default_text(p["firstName"]), F.lit("")), F.lit(" "), F.coalesce(default_text(p["lastName"]), F.lit(""))))
    return rows.select(
        "team", "group", p["id"].alias("player_id"), full.alias("player_name"), p["positionCode"].alias("position"),
        p["sweaterNumber"].alias("sweater_number"), p["shootsCatches"].alias("shoots_catches"), p["birthDate"].alias("birth_date"),
        p["heightInInches"].alias("height_inches"), p["weightInPounds"].alias("weight_pounds"),
    )


_ROSTER_PLAYER = (
    f"struct<id:bigint,firstName:{_TEXT},lastName:{_TEXT},positionCode:string,sweaterNumber:bigint,shootsCatches:string,"
    "birthDate:string,heightInInches:bigint,weightInPounds:bigint>"
)
ROSTER = ", ".join(f"{g} array<{_ROSTER_PLAYER}>" for g in ("forwards", "defensemen", "goalies"))
STANDINGS = (
    f"standings array<struct<seasonId:bigint,teamAbbrev:{_TEXT},teamName:{_TEXT},wins:bigint,losses:bigint,otLosses:bigint,"
    "points:bigint,pointPctg:double,gamesPlayed:bigint,streakCode:string,streakCount:bigint>>"
)


def standings_rows(docs: DataFrame) -> DataFrame:
    """Standings entries with their snapshot date; the season of the file fills in where the entry has none."""
    rows = docs.select("snapshot_date", F.col("season").alias("_season"), F.explode("standings").alias("s"))
    s = F.col("s")
    return rows.select(
        "snapshot_date", F.coalesce(s["seasonId"], F.col("_season")).alias("season"), default_text(s["teamAbbrev"]).alias("team"),
        default_text(s["teamName"]).alias("team_name"),
        *[s[c].alias(n) for c, n in (
            ("wins", "wins"), ("losses", "losses"), ("otLosses", "ot_losses"), ("points", "points"), ("pointPctg", "points_pct"),
            ("gamesPlayed", "games_played"), ("streakCode", "streak_code"), ("streakCount", "streak_count"),
        )],
    )


def page_rows(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of paginated statistics, all pages of a season together."""
    return pages.select(*carry, F.explode("data").alias("d")).select(*carry, "d.*")


def team_codes(teams: DataFrame) -> DataFrame:
    """Team id to code, the raw code filling in; teams without any are left out."""
    code = F.coalesce(F.nullif(F.col("triCode"), F.lit("")), F.nullif(F.col("rawTricode"), F.lit("")))
    return teams.select(F.col("id").alias("team_id"), F.col("fullName").alias("full_name"), code.alias("code")).filter(
        F.col("team_id").isNotNull() & F.col("code").isNotNull()
    )


def active_codes(codes: DataFrame, season_rows: DataFrame) -> DataFrame:
    """Codes of the teams with rows in a season; with none at all, every code."""
    active = codes.join(season_rows.select(F.col("teamId").alias("team_id")).distinct(), "team_id", "left_semi")
    none = active.agg(F.count(F.lit(1)) == 0).scalar()
    return active.select("code").unionByName(codes.filter(none).select("code")).distinct()


def club_stats(summary: DataFrame, codes: DataFrame) -> DataFrame:
    """Season totals per club in display units, joined by full name."""
    joined = summary.join(codes, summary["teamFullName"] == codes["full_name"])
    shown = lambda c, scale, places: F.rint(F.coalesce(F.col(c), F.lit(0.0)) * scale * 10.0**places) / 10.0**places
    return joined.select(
        "code",
        shown("goalsForPerGame", 1, 2).alias("goals_for"),
        shown("goalsAgainstPerGame", 1, 2).alias("goals_against"),
        shown("powerPlayPct", 100, 1).alias("power_play"),
        shown("penaltyKillPct", 100, 1).alias("penalty_kill"),
        shown("shotsForPerGame", 1, 1).alias("shots_per_game"),
        shown("shotsAgainstPerGame", 1, 1).alias("shots_against"),
        shown("faceoffWinPct", 100, 1).alias("faceoff_win"),
        F.coalesce(F.col("gamesPlayed"), F.lit(0)).cast("long").alias("games_played"),
    )


def standings_end(calendar: DataFrame, season: int, today: str) -> DataFrame:
    """Last day standings exist for a season: its listed end, but not after today; today where it is not listed. One row."""
    end = F.max(F.when(F.col("id") == season, iso_date(F.col("standingsEnd"))))
    day = F.lit(today).cast("date")
    return calendar.agg(F.least(F.coalesce(end, day), day).alias("standings_end"))
