"""Contest-shaped views over the sample warehouse tables.

Every view is a lazy DataFrame over the whole parquet table it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import season_of
from ..plans.scan import blocked, running_sum


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; its schema is read from the footer once per path."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def games(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order as a game between two teams (nations) of one pool."""
    return games_from(table(spark, folder, "orders"), table(spark, folder, "customer"))


def games_from(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The same from a batch or a stream of orders."""
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    customers = customers.select("c_custkey", "c_nationkey")
    key, team = F.col("o_orderkey"), F.col("c_nationkey")
    away_score = (key * 17 + F.col("o_custkey")) % 7
    raw = (key * 31) % 7
    day = F.col("o_orderdate").cast("date")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("game_id"),
        day.alias("game_date"),
        season_of(day).alias("season"),
        F.when(F.month(day).isin(5, 6), 3).otherwise(2).cast("long").alias("game_type"),
        F.when(day >= F.lit("2001-06-01").cast("date"), "FUT").otherwise("OFF").alias("game_state"),
        F.when(key % 4 == 3, "OT").otherwise("REG").alias("last_period_type"),
        (team % 5).cast("long").alias("pool"),
        team.cast("long").alias("home_team"),
        ((team + 5 * (1 + key % 4)) % 25).cast("long").alias("away_team"),
        (raw + F.when(raw == away_score, 1).otherwise(0)).alias("home_score"),
        away_score.alias("away_score"),
    )


def _pseudo(multiplier: int) -> Column:
    return ((F.col("game_id") * multiplier) % 1000 + F.lit(0.5)) / 1000


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Walk-forward predictions: outcome and four model probabilities per game."""
    return games(spark, folder).select(
        "game_id",
        "season",
        "game_date",
        "game_type",
        "game_state",
        "pool",
        "home_team",
        "away_team",
        "home_score",
        "away_score",
        (F.col("home_score") > F.col("away_score")).cast("long").alias("y"),
        _pseudo(7919).alias("p_home"),
        _pseudo(6101).alias("p_logit"),
        _pseudo(4409).alias("p_hgb"),
        _pseudo(3571).alias("elo_prob_home"),
    )


def _play_columns() -> dict:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.col("event_type")
    return {
        "event_type": F.when(kind == "purchase", "goal")
        .when(kind == "click", "shot-on-goal")
        .when(kind == "view", "missed-shot")
        .when(kind == "error", "penalty")
        .otherwise("faceoff"),
        "side": F.when(k % 2 == 0, "home").otherwise("away"),
        "situation_code": F.when(k % 10 < 2, "1541").when(k % 10 < 4, "1451").otherwise("1551"),
        "penalty_minutes": F.when(kind == "error", F.when(k % 5 == 0, 5).otherwise(2)).cast("long"),
    }


def play_events(spark: SparkSession, folder: str) -> DataFrame:
    """The plays without their place in the game, for what counts them in any order."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return events.select(F.col("user_id").alias("game_id"), "event_id", "ts", *[c.alias(n) for n, c in _play_columns().items()])


def plays(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event; a user's events are the plays of one game."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "props")
    numbered = blocked(
        events,
        ["user_id"],
        {"minute": F.floor(F.col("ts").cast("timestamp").cast("long") / 60)},
        [F.col("ts"), F.col("event_id")],
        [running_sum("n", F.lit(1))],
    )
    made = _play_columns()
    return numbered.select(
        F.col("user_id").alias("game_id"), "event_id", "ts", F.col("n").alias("sort_order"), made["event_type"].alias("event_type"),
        made["side"].alias("side"), made["situation_code"].alias("situation_code"), ((F.col("n") - 1) * 40).alias("seconds_elapsed"),
        made["penalty_minutes"].alias("penalty_minutes"),
    )


def detailed_plays(spark: SparkSession, folder: str) -> DataFrame:
    """Plays with every kind of event, goalies in net, stated scores and the time each play was fed.

    Games start ten minutes apart, so many are under way at any time.
    """
    kind, event = F.col("event_type"), F.col("event_id")
    shots = kind.isin("goal", "shot-on-goal")
    other = F.element_at(F.array(*[F.lit(k) for k in ("hit", "giveaway", "takeaway", "blocked-shot", "faceoff")]), (event % 5 + 1).cast("int"))
    offset = F.col("game_id") % 1000 * 600 + F.col("seconds_elapsed")
    return plays(spark, folder).drop("ts").select(
        "*",
        F.when(shots, F.when(event % 4 == 1, 0).when(event % 4 > 1, 100 + event % 3)).alias("goalie_in_net_id"),
        F.when((kind == "goal") & (event % 3 == 0), event % 5).alias("home_score_event"),
        F.when((kind == "goal") & (event % 4 < 2), event % 3).alias("away_score_event"),
        offset.alias("fed_second"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=offset.cast("decimal(18,6)"))).alias("fed_at"),
    ).withColumn("event_type", F.when(kind == "faceoff", other).otherwise(kind))


def line_items(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    """The line items of the given games, with the columns that box scores, goalies and skaters are made of."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"
    )
    return lines.join(ids.select(F.col("game_id").alias("l_orderkey")), "l_orderkey", "left_semi")


def skater_lines(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """One row per line item (of ``lines``, all by default) as a skater's box-score line."""
    lines = (table(spark, folder, "lineitem") if lines is None else lines).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    return lines.select(
        F.col("l_orderkey").alias("game_id"),
        (F.col("l_linenumber") % 2).cast("long").alias("is_home"),
        part.alias("player_id"),
        (supplier % 3).alias("goals"),
        (part % 3).alias("assists"),
        (supplier % 3 + part % 3).alias("points"),
        (F.col("l_quantity").cast("long") % 8).alias("shots"),
        (part % 7).alias("hits"),
        (supplier % 5).alias("blocked_shots"),
        _toi().alias("time_on_ice"),
    )


def _toi() -> Column:
    minutes = F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")
    seconds = F.lpad((F.col("l_partkey") % 60).cast("string"), 2, "0")
    return F.concat(minutes, F.lit(":"), seconds)


def goalie_lines(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Line items (of ``lines``, all by default) flagged N as goalie lines."""
    lines = (table(spark, folder, "lineitem") if lines is None else lines).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
    )
    shots = F.col("l_partkey") % 20 + 20
    conceded = F.col("l_partkey") % 6
    return lines.filter(F.col("l_returnflag") == "N").select(
        F.col("l_orderkey").alias("game_id"),
        (F.col("l_linenumber") % 2).cast("long").alias("is_home"),
        F.col("l_suppkey").alias("player_id"),
        F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("goalie_name"),
        shots.alias("shots_against"),
        conceded.alias("goals_against"),
        ((shots - conceded) / shots).alias("save_pct"),
        _toi().alias("time_on_ice"),
        F.col("l_partkey").alias("line_order"),
    )


def box_scores(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Team box-score lines from line items (``lines``, all by default): two rows per game at most."""
    lines = (table(spark, folder, "lineitem") if lines is None else lines).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"
    )
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    flag = F.col("l_returnflag")
    return lines.groupBy(
        F.col("l_orderkey").alias("game_id"), (F.col("l_linenumber") % 2).cast("long").alias("is_home")
    ).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("shots_for"),
        count(flag == "R").alias("powerplay_goals"),
        count(flag.isin("R", "A")).alias("powerplay_opportunities"),
        F.sum(F.col("l_linenumber").cast("long")).alias("penalty_minutes"),
        # hundredths are summed as integers, so the mean does not depend on row order
        (F.sum(F.rint(F.col("l_discount") * 100).cast("long")) / (100 * F.count(F.lit(1)))).alias("faceoff_win_pct"),
        F.sum(F.col("l_suppkey") % 5).alias("blocked_shots"),
        F.sum(F.col("l_partkey") % 7).alias("hits"),
        count(F.col("l_linestatus") == "F").alias("giveaways"),
        count(F.col("l_linestatus") == "O").alias("takeaways"),
    )


def picks(spark: SparkSession, folder: str) -> DataFrame:
    """Member picks, one per (member, game)."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("game_id"),
        F.col("o_orderdate").cast("date").alias("made_on"),
        F.when(F.col("o_orderkey") % 3 == 0, "away").otherwise("home").alias("pick"),
    )


def teams(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation")
    return nations.select(
        F.col("n_nationkey").cast("long").alias("team"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("long").alias("region"),
    )
