"""Leak-free form: every feature of a game uses only games dated strictly before it.

All features depend on (team, season, date) alone, so they are computed once
per team-day on pre-aggregated rows and joined back to games. A team-day keeps
its day totals and its last few games; windows then run over days, of which a
team has at most one per calendar date, however many games it played.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contest import is_completed

# fixed values: metrics averaged over the last games, and the columns they become
LAST_5 = ("win", "goals_for", "goals_against")
LAST_10 = (
    "win", "shots_for", "shots_against", "powerplay_goals", "penalty_minutes", "faceoff_win_pct", "blocked_shots",
    "hits", "giveaways", "takeaways", "es_shot_attempts_for", "es_shot_attempts_against", "es_goals_for",
    "es_goals_against", "skaters_points", "skaters_shots", "skaters_avg_toi_seconds",
)
LAST_3 = (
    "starting_goalie_save_pct", "starting_goalie_goals_against", "starting_goalie_shots_against",
    "starting_goalie_quality_start",
)

# fixed values: per-team feature columns in output order
TEAM_FEATURES = (
    "rest_days", "games_last_3_days", "games_last_7_days", "games_last_14_days", "back_to_back",
    "last_5_win_pct", "last_10_win_pct", "last_5_goals_for_avg", "last_5_goals_against_avg",
    "last_10_shots_for_avg", "last_10_shots_against_avg", "season_points_pct_before_game", "goal_diff_last_10",
    "home_win_pct_before_game", "road_win_pct_before_game", "home_goal_diff_avg_before_game",
    "road_goal_diff_avg_before_game", "last_10_powerplay_goals_avg", "last_10_penalty_minutes_avg",
    "last_10_faceoff_win_pct_avg", "last_10_blocked_shots_avg", "last_10_hits_avg", "last_10_giveaways_avg",
    "last_10_takeaways_avg", "last_10_es_shot_attempts_for_avg", "last_10_es_shot_attempts_against_avg",
    "last_10_es_shot_attempt_share", "last_10_es_goals_for_avg", "last_10_es_goals_against_avg",
    "last_10_skaters_points_avg", "last_10_skaters_shots_avg", "last_10_skaters_avg_toi_seconds",
    "last_starting_goalie_id", "last_starting_goalie_name", "last_3_starting_goalie_save_pct",
    "last_3_starting_goalie_goals_against_avg", "last_3_starting_goalie_shots_against_avg",
    "last_3_starting_goalie_quality_start_pct",
)

# fixed values: features without a plain home-minus-away difference
_NO_DIFF = (
    "season_points_pct_before_game", "home_win_pct_before_game", "road_win_pct_before_game",
    "home_goal_diff_avg_before_game", "road_goal_diff_avg_before_game", "last_starting_goalie_id",
    "last_starting_goalie_name",
)
# fixed values: differences of differently named or opposite-split columns
SPECIAL_DIFFS = {
    "season_points_pct_diff": ("home_season_points_pct_before_game", "away_season_points_pct_before_game"),
    "home_ice_split_win_pct_diff": ("home_home_win_pct_before_game", "away_road_win_pct_before_game"),
    "home_ice_split_goal_diff_avg_diff": ("home_home_goal_diff_avg_before_game", "away_road_goal_diff_avg_before_game"),
}


def diff_pairs() -> dict[str, tuple[str, str]]:
    """The 34 difference columns, each with the two columns it subtracts."""
    plain = {f"{n}_diff": (f"home_{n}", f"away_{n}") for n in TEAM_FEATURES if n not in _NO_DIFF}
    return plain | SPECIAL_DIFFS


def eligible(games: DataFrame, types: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Completed games of the wanted types with a known result."""
    return games.filter(
        F.col("game_type").isin(*types)
        & is_completed(F.col("game_state"))
        & F.col("home_score").isNotNull()
        & F.col("away_score").isNotNull()
    )


def team_games(games: DataFrame) -> DataFrame:
    """Two rows per game, one per side."""
    carried = [c for c in games.columns if c not in ("home_team", "away_team", "home_score", "away_score")]

    def side(team: str, opponent: str, is_home: int) -> Column:
        return F.struct(
            F.col(f"{team}_team").alias("team"),
            F.col(f"{opponent}_team").alias("opponent"),
            F.lit(is_home).cast("long").alias("is_home"),
            F.col(f"{team}_score").cast("double").alias("goals_for"),
            F.col(f"{opponent}_score").cast("double").alias("goals_against"),
        )

    sides = games.select(*carried, F.explode(F.array(side("home", "away", 1), side("away", "home", 0))).alias("s"))
    won = F.col("goals_for") > F.col("goals_against")
    return sides.select(*carried, "s.*").withColumns(
        {"win": won.cast("double"), "points": F.when(won, 2.0).otherwise(0.0)}
    )


@dataclass(frozen=True)
class TeamDays:
    """Team-day rows carrying everything known before the day starts."""

    rows: DataFrame
    metrics: tuple[str, ...]


def last_items(items: Column, n: int) -> Column:
    """The last ``n`` items of an array, or all of a shorter one."""
    return F.slice(items, F.greatest(F.size(items) - (n - 1), F.lit(1)), n)


def latest_rows_of_day(df: DataFrame, day_keys: list[str], depth: int = 10) -> DataFrame:
    """The rows a day's last ``depth`` games leave: what is wider is joined to these alone."""
    newest = Window.partitionBy(*day_keys).orderBy(F.col("game_id").desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= depth).drop("_rank")


def latest_of_day(df: DataFrame, day_keys: list[str], payload: list[str], depth: int, out: str) -> DataFrame:
    """Per day, its last ``depth`` games by id as an array in order.

    The row limit is applied before the shuffle, so a day with very many games
    sends at most ``depth`` rows per task.
    """
    newest = Window.partitionBy(*day_keys).orderBy(F.col("game_id").desc())
    kept = df.select(*day_keys, "game_id", *[p for p in payload if p not in day_keys + ["game_id"]]).withColumn(
        "_rank", F.row_number().over(newest)
    ).filter(F.col("_rank") <= depth)
    fields = ["game_id", *[p for p in payload if p != "game_id"]]
    return kept.groupBy(*day_keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))


def team_days(
    history: DataFrame, asks: DataFrame | None, metrics: tuple[str, ...], depth: int = 10, totals: DataFrame | None = None
) -> TeamDays:
    """Everything known of each asked (team, season, date) from strictly earlier games of ``history``.

    ``history`` is one row per (game, team); ``asks`` has columns team, season,
    game_date, and None asks for the days of the history itself, which needs no
    further read. ``totals`` may be the same games without the joined-on metrics:
    day totals need only the scores, so the joins then run once. Without
    ``metrics`` only day totals are made and no recent games are listed.
    """
    diff = "goals_for - goals_against"
    sums = {
        "n": "1",
        "pts": "points",
        "home_n": "CASE WHEN is_home = 1 THEN 1 ELSE 0 END",
        "home_win": "CASE WHEN is_home = 1 THEN win ELSE 0 END",
        "home_gd": f"CASE WHEN is_home = 1 THEN {diff} END",
        "road_n": "CASE WHEN is_home = 0 THEN 1 ELSE 0 END",
        "road_win": "CASE WHEN is_home = 0 THEN win ELSE 0 END",
        "road_gd": f"CASE WHEN is_home = 0 THEN {diff} END",
    }
    key = ["team", "season", "game_date"]
    played = (history if totals is None else totals).selectExpr(*key, *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in sums.items()])
    if asks is not None:
        played = played.unionByName(asks.selectExpr(*key, *[f"0D AS {n}" for n in sums]))
    daily = played.groupBy(*key).agg(*[F.sum(n).alias(n) for n in sums])

    if metrics:
        day = ["team", "game_date"]
        daily = daily.join(latest_of_day(history, day, list(metrics), depth, "games_of_day"), day, "left")

    team = "PARTITION BY team ORDER BY unix_date(game_date)"
    season = "PARTITION BY team, season ORDER BY unix_date(game_date)"
    before = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    daily = daily.selectExpr(
        "*",
        f"max(CASE WHEN n > 0 THEN game_date END) OVER ({team} {before}) AS last_date",
        *[f"coalesce(sum(n) OVER ({team} RANGE BETWEEN {d} PRECEDING AND 1 PRECEDING), 0D) AS n_{d}" for d in (3, 7, 14)],
        *[f"sum({n}) OVER ({season} {before}) AS season_{n}" for n in sums],
        f"coalesce(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER ({team} {before}), 0) AS _position",
    )
    if not metrics:
        return TeamDays(daily.drop("_position"), metrics)
    # _position counts the team's earlier days with games; days that are only asked about share the next one.
    # `depth` days with games always hold at least `depth` games.
    frame = Window.partitionBy("team").orderBy("_position").rangeBetween(-depth, -1)
    recent = F.flatten(F.collect_list("games_of_day").over(frame))
    rows = daily.withColumn("_all", recent).withColumn("recent", last_items(F.col("_all"), depth))
    return TeamDays(rows.drop("_all", "_position", "games_of_day"), metrics)


def _rounded(expression: str, places: int = 4) -> str:
    scale = f"{10.0**places:.1f}D"
    return f"rint(({expression}) * {scale}) / {scale}"


def mean_of_last(metric: str, n: int) -> str:
    """Mean of a metric over the last ``n`` games, missing values skipped; null without any."""
    return _rounded(f"avg(CASE WHEN r <= {n} THEN nanvl(CAST(g.{metric} AS DOUBLE), NULL) END)")


def schedule_columns(rest_cap: int | None = None) -> dict[str, str]:
    """Rest, back-to-back and games in the last days; ``rest_cap`` is 14 for serving."""
    gap = "CAST(datediff(game_date, last_date) AS DOUBLE)"
    return {
        "rest_days": f"CASE WHEN {gap} > {rest_cap} THEN {float(rest_cap)}D ELSE {gap} END" if rest_cap else gap,
        "games_last_3_days": "n_3",
        "games_last_7_days": "n_7",
        "games_last_14_days": "n_14",
        "back_to_back": f"CASE WHEN {gap} = 1 THEN 1.0D ELSE 0.0D END",
    }


def split_columns() -> dict[str, str]:
    """Season-to-date points share and the home and road records, null before the first game."""
    return {
        "season_points_pct_before_game": _rounded("try_divide(season_pts, 2 * season_n)"),
        "home_win_pct_before_game": _rounded("try_divide(season_home_win, season_home_n)"),
        "road_win_pct_before_game": _rounded("try_divide(season_road_win, season_road_n)"),
        "home_goal_diff_avg_before_game": _rounded("try_divide(season_home_gd, season_home_n)"),
        "road_goal_diff_avg_before_game": _rounded("try_divide(season_road_gd, season_road_n)"),
    }


def form_columns(metrics: tuple[str, ...]) -> dict[str, str]:
    """Rolling means of the metrics that are present, over exploded recent games (``g``, newest ``r`` = 1)."""
    out: dict[str, str] = {}
    for m in LAST_5:
        out[f"last_5_{m}_pct" if m == "win" else f"last_5_{m}_avg"] = mean_of_last(m, 5)
    for m in LAST_10:
        if m in metrics:
            name = {"win": "last_10_win_pct", "skaters_avg_toi_seconds": "last_10_skaters_avg_toi_seconds"}
            out[name.get(m, f"last_10_{m}_avg")] = mean_of_last(m, 10)
    out["goal_diff_last_10"] = _rounded("sum(CASE WHEN r <= 10 THEN g.goals_for - g.goals_against END)")
    if "es_shot_attempts_for" in metrics:
        own = "coalesce(sum(CASE WHEN r <= 10 THEN g.es_shot_attempts_for END), 0D)"
        other = "coalesce(sum(CASE WHEN r <= 10 THEN g.es_shot_attempts_against END), 0D)"
        out["last_10_es_shot_attempt_share"] = _rounded(f"try_divide({own}, {own} + {other})")
    if "starting_goalie_id" in metrics:
        for c in ("id", "name"):
            out[f"last_starting_goalie_{c}"] = f"max(CASE WHEN r = 1 THEN g.starting_goalie_{c} END)"
        for m in LAST_3:
            ending = {"starting_goalie_save_pct": "", "starting_goalie_quality_start": "_pct"}.get(m, "_avg")
            out[f"last_3_{m}{ending}"] = mean_of_last(m, 3)
    return out


def features(days: TeamDays, rest_cap: int | None = None) -> DataFrame:
    """Feature columns per (team, season, game_date), in the fixed order where present.

    The few recent games of a day are exploded and averaged by a plain
    aggregation; rows are already clustered by team, so no shuffle is added.
    """
    key = ("team", "season", "game_date")
    per_day = schedule_columns(rest_cap) | split_columns()
    rolling = form_columns(days.metrics)
    rows = days.rows.selectExpr(*key, *[f"{e} AS {n}" for n, e in per_day.items()], "size(recent) AS _size", "recent")
    games = rows.selectExpr(*key, *per_day, "_size", "posexplode_outer(recent) AS (_at, g)")
    games = games.withColumn("r", F.expr("_size - _at"))
    made = games.groupBy(*key).agg(
        *[F.expr(f"first({n}) AS {n}") for n in per_day], *[F.expr(f"{e} AS {n}") for n, e in rolling.items()]
    )
    return made.select(*key, *[n for n in TEAM_FEATURES if n in per_day or n in rolling])


def asks_of(games: DataFrame) -> DataFrame:
    """Distinct (team, season, date) of both sides of the given games."""
    pair = F.explode(F.array(F.col("home_team"), F.col("away_team"))).alias("team")
    return games.select(pair, "season", "game_date").distinct()


def attach(games: DataFrame, team_features: DataFrame) -> DataFrame:
    """Join team-day features to games as ``home_*`` and ``away_*`` columns.

    A team-day is one row, so a hash join fits and the games are not sorted. The
    features pass the joins as one value a side: copying dozens of columns by
    themselves makes methods too large for the JVM to compile.
    """
    names = [c for c in team_features.columns if c not in ("team", "season", "game_date")]
    out = games
    for side in ("home", "away"):
        part = team_features.select(F.col("team").alias(f"{side}_team"), "season", "game_date", F.struct(*names).alias(f"_{side}"))
        out = out.join(part.hint("shuffle_hash"), [f"{side}_team", "season", "game_date"], "left")
    keys = ["away_team", "season", "game_date", "home_team"]
    rest = [c for c in games.columns if c not in keys]
    return out.select(*keys, *rest, *[F.col(f"_{side}.{n}").alias(f"{side}_{n}") for side in ("home", "away") for n in names])


def with_differences(df: DataFrame) -> DataFrame:
    """Add every home-minus-away column whose two inputs are present; null when either side is."""
    have = set(df.columns)
    pairs = {n: p for n, p in diff_pairs().items() if have.issuperset(p)}
    return df.selectExpr(
        "*", *[_rounded(f"CAST({h} AS DOUBLE) - CAST({a} AS DOUBLE)") + f" AS {n}" for n, (h, a) in pairs.items()]
    )


SCORE_METRICS = ("win", "goals_for", "goals_against")


def score_features(games: DataFrame, asked: DataFrame | None = None, rest_cap: int | None = None) -> DataFrame:
    """Score-only form of both sides for the asked games (the completed ones by default)."""
    done = eligible(games)
    days = team_days(team_games(done), None if asked is None else asks_of(asked), SCORE_METRICS)
    return attach(done if asked is None else asked, features(days, rest_cap))
