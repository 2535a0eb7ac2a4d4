"""Features of a pairing: head-to-head record, series state and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contest import PLAYOFF, REGULAR, pair_high, pair_low, series_code
from ..functions.numbers import round_even
from ..plans.scan import blocked, id_block, running_sum
from .history import last_items, latest_of_day


def head_to_head(done: DataFrame, asked: DataFrame, depth: int = 5, keys_of: DataFrame | None = None) -> DataFrame:
    """Meetings in the last 365 days and the home side's record in the last five, from strictly earlier dates.

    Pairs are stored lower team first and turned to the home side at the end.
    ``keys_of`` may be a narrower table with the same pairs and dates as
    ``asked``, so that a costly ``asked`` is evaluated once.
    """
    low, high = pair_low(F.col("home_team"), F.col("away_team")), pair_high(F.col("home_team"), F.col("away_team"))
    low_is_home = F.col("home_team") == F.col("low")
    margin = F.col("home_score").cast("double") - F.col("away_score")
    meetings = done.withColumns({"low": low, "high": high}).select(
        "low", "high", "game_date", "game_id", F.when(low_is_home, margin).otherwise(-margin).alias("low_margin")
    )
    key = ["low", "high", "game_date"]
    asks = (asked if keys_of is None else keys_of).withColumns({"low": low, "high": high}).select(*key)
    daily = (
        meetings.select(*key, F.lit(1).alias("n"))
        .unionByName(asks.select(*key, F.lit(0).alias("n")))
        .groupBy(*key)
        .agg(F.sum("n").cast("double").alias("n"))
        .join(latest_of_day(meetings, key, ["low_margin"], depth, "games_of_day"), key, "left")
    )
    by_pair = Window.partitionBy("low", "high")
    number = F.unix_date("game_date")
    in_year = by_pair.orderBy(number).rangeBetween(-365, -1)
    earlier = by_pair.orderBy(number).rangeBetween(Window.unboundedPreceding, -1)
    daily = daily.select(
        *key,
        "games_of_day",
        F.coalesce(F.sum("n").over(in_year), F.lit(0.0)).alias("in_year"),
        F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(earlier), F.lit(0)).alias("position"),
    )
    frame = by_pair.orderBy("position").rangeBetween(-depth, -1)
    recent = F.flatten(F.collect_list("games_of_day").over(frame))
    daily = daily.withColumn("_all", recent).withColumn("recent", last_items(F.col("_all"), depth))

    def total(value) -> Column:
        return F.aggregate("recent", F.lit(0.0), lambda acc, g: acc + value(g["low_margin"]))

    record = daily.select(
        *key,
        "in_year",
        F.size("recent").cast("double").alias("n"),
        total(lambda m: F.when(m > 0, 1.0).otherwise(0.0)).alias("wins"),
        total(lambda m: m).alias("margin"),
    )
    joined = asked.withColumns({"low": low, "high": high}).join(record, key, "left")
    home_is_low = F.col("home_team") == F.col("low")
    wins = F.when(home_is_low, F.col("wins")).otherwise(F.col("n") - F.col("wins"))
    diff = F.when(home_is_low, F.col("margin")).otherwise(-F.col("margin"))
    out = joined.select(
        *[joined[c] for c in asked.columns],
        F.coalesce("in_year", F.lit(0.0)).alias("h2h_games_last_365_days"),
        round_even(F.try_divide(wins, F.col("n")), 4).alias("h2h_home_team_win_pct_last_5"),
        round_even(F.try_divide(diff, F.col("n")), 4).alias("h2h_home_team_goal_diff_avg_last_5"),
    )
    return out


# fixed values: series columns in output order
SERIES_COLUMNS = (
    "playoff_series_game_number", "home_series_wins_before", "away_series_wins_before", "series_win_diff_before",
    "home_elimination_game", "away_elimination_game",
)


def series_state(done: DataFrame) -> DataFrame:
    """State of the playoff series before each game, in row order (date, id); zeros outside playoffs.

    A series is between two teams, so wins are counted for the lower and the higher team.
    """
    low = pair_low(F.col("home_team"), F.col("away_team"))
    home_won = F.col("home_score") > F.col("away_score")
    low_won = (F.col("home_team") == F.col("_low")) == home_won
    playoffs = done.filter(F.col("game_type") == PLAYOFF).withColumn("_low", low).withColumns(
        {
            "_series": series_code(F.col("game_id"), F.col("home_team"), F.col("away_team")),
            "_low_won": low_won.cast("long"),
        }
    )
    run = blocked(
        playoffs,
        ["season", "_series"],
        {"day": F.col("game_date"), "ids": id_block("game_id")},
        [F.col("game_date"), F.col("game_id")],
        [running_sum("_n", F.lit(1)), running_sum("_low_wins", F.col("_low_won"))],
    )
    low_before = F.col("_low_wins") - F.col("_low_won")
    high_before = F.col("_n") - 1 - low_before
    home_is_low = F.col("home_team") == F.col("_low")
    home, away = F.when(home_is_low, low_before).otherwise(high_before), F.when(home_is_low, high_before).otherwise(low_before)
    values = (F.col("_n"), home, away, home - away, (away == 3).cast("long"), (home == 3).cast("long"))
    in_series = run.select(*done.columns, *[v.cast("long").alias(n) for n, v in zip(SERIES_COLUMNS, values, strict=True)])
    outside = done.filter(F.col("game_type") != PLAYOFF).select(
        "*", *[F.lit(0).cast("long").alias(n) for n in SERIES_COLUMNS]
    )
    return in_series.unionByName(outside)


def latest_features(dataset: DataFrame, columns: list[str], *, prefer_regular: bool = False) -> DataFrame:
    """Each team's feature values from its latest game row, without their ``home_``/``away_`` prefix.

    ``columns`` are the unprefixed names. On equal dates the home row wins
    (``prefer_regular`` off) or, for serving, regular-season games come first
    and then (date, id). The pick is a max over a struct, so it is combined
    before the shuffle.
    """

    def side(team: str, is_home: int) -> Column:
        return F.struct(
            F.col(f"{team}_team").alias("team"),
            F.lit(is_home).alias("is_home"),
            *[F.col(f"{team}_{c}").alias(c) for c in columns],
        )

    rows = dataset.select(
        "game_id", "game_date", "game_type", F.explode(F.array(side("home", 1), side("away", 0))).alias("s")
    )
    if prefer_regular:
        rank = F.struct((F.col("game_type") == REGULAR).cast("int"), "game_date", "game_id", F.col("s.is_home"))
    else:
        rank = F.struct(F.col("game_date"), F.col("s.is_home"), F.col("game_id"))
    newest = rows.groupBy(F.col("s.team").alias("team")).agg(F.max_by(F.struct("game_id", "game_date", "s"), rank).alias("r"))
    return newest.select(
        "team",
        F.col("r.game_id").alias("source_game_id"),
        F.col("r.game_date").alias("source_date"),
        *[F.col(f"r.s.{c}").alias(c) for c in columns],
    )
