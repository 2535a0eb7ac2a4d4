"""Picks, leaderboards, result pages, comment threads and the team table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contest import PLAYOFF, POINTS_RIGHT, POINTS_WRONG, REGULAR, is_completed, pick_home
from ..functions.numbers import round_even, tidy, width_of
from ..plans.scan import blocked, id_block, running_sum, with_halo, without_halo

# fixed values: page sizes and the games after which a season's own records are shown
PAGE_SIZE = 25
SHOWN_AFTER = 64
# fixed values: compared statistics — column, label, largest value, unit, higher is better
COMPARED = (
    ("goals_for", "Goals for / game", 5.0, "", True),
    ("goals_against", "Goals against / game", 5.0, "", False),
    ("power_play", "Power play", 35.0, "%", True),
    ("penalty_kill", "Penalty kill", 100.0, "%", True),
    ("shots_per_game", "Shots / game", 40.0, "", True),
    ("faceoff_win", "Faceoff win", 65.0, "%", True),
)
# fixed values: strategies of the back-test
STRATEGIES = ("ModelFollower", "HomeIceFan", "RoadWarrior", "FormChaser", "Contrarian")


def settle(picks: DataFrame, results: DataFrame) -> DataFrame:
    """Score picks whose game is final: 100 when right, 10 when wrong; picks settled before stay as they are.

    ``results`` has ``game_id`` and ``winner`` (null while not final), one row per game.
    """
    done = results.filter(F.col("winner").isNotNull()).select("game_id", "winner")
    joined = picks.join(done, "game_id", "left")
    now = F.col("is_correct").isNull() & F.col("winner").isNotNull()
    right = (F.col("pick") == F.col("winner")).cast("long")
    return joined.withColumns(
        {
            "points": F.when(now, F.when(right == 1, POINTS_RIGHT).otherwise(POINTS_WRONG).cast("long")).otherwise(F.col("points")),
            "is_correct": F.when(now, right).otherwise(F.col("is_correct")),
        }
    ).drop("winner")


def latest_picks(log: DataFrame, order: list[str]) -> DataFrame:
    """One pick per (member, game): the last write wins."""
    newest = Window.partitionBy("user_id", "game_id").orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1).drop("_r")


def current_streaks(settled: DataFrame, key: str = "user_id") -> DataFrame:
    """Right picks since the latest miss, newest game first.

    The latest miss is one aggregate per member, so nobody's picks are sorted.
    """
    last_miss = settled.filter(F.col("is_correct") == 0).groupBy(key).agg(F.max("game_id").alias("_miss"))
    since = settled.join(last_miss, key, "left")
    run = F.sum(F.when(F.col("_miss").isNull() | (F.col("game_id") > F.col("_miss")), 1).otherwise(0))
    return since.groupBy(key).agg(run.alias("streak"))


def leaderboard(settled: DataFrame, key: str = "user_id") -> DataFrame:
    """Members by points, then right picks, then id, with accuracy and current streak.

    The rank runs over all members; it is taken in blocks of equal points and
    right picks and ranges of ids, not in one task.
    """
    # sums, latest misses and streaks read this one exchange; a member's picks are spread over id ranges
    rows = settled.filter(F.col("is_correct").isNotNull()).repartition(F.col(key), id_block("game_id"))
    sums = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_picks"), F.sum("is_correct").alias("correct_picks"), F.sum("points").alias("points")
    )
    both = sums.join(current_streaks(rows, key), key)
    return ranked(both, key).withColumn("accuracy", round_even(F.col("correct_picks") / F.col("total_picks") * 100, 1))


def ranked(board: DataFrame, key: str) -> DataFrame:
    numeric = dict(board.dtypes)[key] in ("bigint", "int")
    levels = {"points": -F.col("points"), "correct": -F.col("correct_picks")}
    if numeric:
        levels["ids"] = id_block(key)
    order = [-F.col("points"), -F.col("correct_picks"), F.col(key)]
    return blocked(board, [], levels, order, [running_sum("rank", F.lit(1))]).withColumn("rank", F.col("rank").cast("long"))


def results_page(preds: DataFrame, only: str = "all", page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of graded games, newest first; the page number is kept within the available ones."""
    rows = graded(preds)
    chosen = {
        "all": F.lit(True),
        "correct": F.col("model_was_right"),
        "missed": ~F.col("model_was_right"),
        "playoffs": F.col("game_type") == PLAYOFF,
    }[only]
    newest = [F.col("game_date").desc(), F.col("game_id").desc()]
    levels = {"day": -F.unix_date("game_date"), "ids": -id_block("game_id")}
    # places are numbered in blocks, so a deep page is as cheap as the first
    numbered = blocked(rows.filter(chosen), [], levels, newest, [running_sum("_place", F.lit(1))])
    pages = F.ceil(numbered.agg(F.max("_place").alias("n")).scalar() / size)
    first = (F.greatest(F.lit(1), F.least(F.lit(page), pages)) - 1) * size
    return numbered.filter((F.col("_place") > first) & (F.col("_place") <= first + size)).orderBy(*newest).drop("_place")


def graded(preds: DataFrame) -> DataFrame:
    """Finished games with the model's favourite and whether it won."""
    p = round_even(100 * F.col("p_home"), 3)
    home_won = F.col("home_score") > F.col("away_score")
    favours_home = p >= 50
    done = preds.filter(is_completed(F.col("game_state")))
    return done.select(
        "game_id", "season", "game_date", "game_type", "home_team", "away_team",
        p.alias("home_win_prob"),
        round_even(100 - p, 3).alias("away_win_prob"),
        F.when(favours_home, F.col("home_team")).otherwise(F.col("away_team")).alias("favourite"),
        F.when(home_won, F.col("home_team")).otherwise(F.col("away_team")).alias("winner"),
        (favours_home == home_won).alias("model_was_right"),
    )


def with_games(predictions: DataFrame, games: DataFrame) -> DataFrame:
    """Predictions with the columns of their game; a prediction of an unknown game keeps nulls there."""
    return predictions.join(games, "game_id", "left")


def history_rows(graded_games: DataFrame, dataset: DataFrame) -> DataFrame:
    """Graded games that have a row in the data set, with its columns; columns both have come from the graded games."""
    fresh = [c for c in dataset.columns if c == "game_id" or c not in graded_games.columns]
    return graded_games.join(dataset.select(*fresh), "game_id")


def season_review(preds: DataFrame, month: str | None = None, team: int | None = None, outcome: str | None = None) -> DataFrame:
    """Graded games filtered by month, by a team on either side and by outcome."""
    rows = graded(preds)
    if month:
        rows = rows.filter(F.date_format("game_date", "yyyy-MM") == month)
    if team is not None:
        rows = rows.filter((F.col("home_team") == team) | (F.col("away_team") == team))
    if outcome:
        rows = rows.filter(F.col("model_was_right") == (outcome == "correct"))
    return rows


def last_form(team_games: DataFrame, keys: list[str], n: int = 5, overtime: bool = False) -> DataFrame:
    """The last ``n`` results per key as text such as ``W,L,O``, oldest first.

    The row limit runs before the shuffle, so a key sends at most ``n`` rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col("game_date").desc(), F.col("game_id").desc())
    lost = F.when(F.col("last_period_type").isin("OT", "SO"), "O").otherwise("L") if overtime else F.lit("L")
    mark = F.when(F.col("win") == 1, "W").otherwise(lost)
    kept = team_games.select(*keys, "game_date", "game_id", mark.alias("mark")).withColumn("_r", F.row_number().over(newest))
    marks = F.array_sort(F.collect_list(F.struct("game_date", "game_id", "mark")))
    return kept.filter(F.col("_r") <= n).groupBy(*keys).agg(F.array_join(F.transform(marks, lambda m: m["mark"]), ",").alias("form"))


def better_run(team_games: DataFrame, n: int = 5) -> DataFrame:
    """Wins of a team in its last ``n`` earlier rows of the season, in row order (date, id)."""
    keys = ["season", "team"]
    numbered = blocked(
        team_games, keys, {"day": F.col("game_date"), "ids": id_block("game_id")},
        [F.col("game_date"), F.col("game_id")], [running_sum("_n", F.lit(1))],
    )
    spread = with_halo(numbered, "_n", n)
    frame = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-n, -1)
    return without_halo(spread.withColumn("run", F.coalesce(F.sum("win").over(frame), F.lit(0.0)))).drop("_n")


def strategy_picks(preds: DataFrame, runs: DataFrame) -> DataFrame:
    """Five picks per playoff game: the model, home, away, the better run (home on a tie) and against the model."""
    side = runs.select("game_id", "is_home", "run")
    games = (
        preds.join(side.filter("is_home = 1").select("game_id", F.col("run").alias("home_run")), "game_id")
        .join(side.filter("is_home = 0").select("game_id", F.col("run").alias("away_run")), "game_id")
    )
    model = F.when(pick_home(F.col("p_home")), "home").otherwise("away")
    other = F.when(pick_home(F.col("p_home")), "away").otherwise("home")
    form = F.when(F.col("away_run") > F.col("home_run"), "away").otherwise("home")
    choices = (model, F.lit("home"), F.lit("away"), form, other)
    picks = F.explode(F.array(*[F.struct(F.lit(n).alias("user_id"), c.alias("pick")) for n, c in zip(STRATEGIES, choices, strict=True)]))
    none = F.lit(None).cast("long")
    return games.select("game_id", picks.alias("c")).select(
        F.col("c.user_id").alias("user_id"), "game_id", F.col("c.pick").alias("pick"), none.alias("is_correct"), none.alias("points")
    )


def likes(clicks: DataFrame) -> DataFrame:
    """Members who like a comment: an odd number of clicks per (comment, member)."""
    n = clicks.groupBy("comment_id", "member").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") % 2 == 1).select("comment_id", "member")


def comment_threads(comments: DataFrame, clicks: DataFrame, member: int) -> DataFrame:
    """Comments with their like count and whether ``member`` likes them; likes are counted before the join."""
    liked = likes(clicks)
    per = liked.groupBy("comment_id").agg(
        F.count(F.lit(1)).alias("likes"), F.max((F.col("member") == member).cast("int")).alias("mine")
    )
    joined = comments.join(per, "comment_id", "left")
    return joined.select(
        *comments.columns, F.coalesce("likes", F.lit(0)).alias("likes"), (F.coalesce("mine", F.lit(0)) == 1).alias("liked_by_me")
    )


def matchup_rows(games: DataFrame, stats: DataFrame) -> DataFrame:
    """Six comparison rows per game with bar widths; a statistic one side lacks is left out."""
    names = [c for c, *_ in COMPARED]
    for side in ("home", "away"):
        part = stats.select(F.col("team").alias(f"{side}_team"), *[F.col(c).alias(f"{side}_{c}") for c in names])
        games = games.join(part, f"{side}_team", "left")

    def row(column: str, label: str, biggest: float, unit: str, higher: bool) -> Column:
        h, a = F.col(f"home_{column}"), F.col(f"away_{column}")
        return F.struct(
            F.lit(label).alias("label"),
            F.lit(unit).alias("unit"),
            h.alias("home_value"),
            a.alias("away_value"),
            tidy(h).alias("home_text"),
            tidy(a).alias("away_text"),
            width_of(h, biggest).alias("home_width"),
            width_of(a, biggest).alias("away_width"),
            (h > a if higher else h < a).alias("home_better"),
        )

    rows = games.select("game_id", F.explode(F.array(*[row(*c) for c in COMPARED])).alias("r")).select("game_id", "r.*")
    return rows.filter(F.col("home_value").isNotNull() & F.col("away_value").isNotNull())


def shown_season(games: DataFrame, season: int) -> DataFrame:
    """The season whose records are shown: the one before until 64 regular games are finished. One row."""
    played = games.filter(
        is_completed(F.col("game_state")) & (F.col("season") == season) & (F.col("game_type") == REGULAR)
    ).agg(F.count(F.lit(1)).alias("played"))
    chosen = F.when(F.col("played") >= SHOWN_AFTER, season).otherwise(season - 10001).cast("long")
    return played.select("played", chosen.alias("shown_season"))


def featured(preds: DataFrame, n: int = 4) -> DataFrame:
    """The next ``n`` upcoming games, or without any the last ``n`` playoff games, newest first."""
    done = is_completed(F.col("game_state"))
    upcoming = preds.filter(~done)
    next_up = upcoming.orderBy("game_date", "game_id").limit(n).withColumn("offseason", F.lit(False))
    none_up = upcoming.agg(F.count(F.lit(1)) == 0).scalar()
    last = preds.filter(done & (F.col("game_type") == PLAYOFF)).orderBy(F.col("game_date").desc(), F.col("game_id").desc()).limit(n)
    return next_up.unionByName(last.filter(none_up).withColumn("offseason", F.lit(True)))


def replay_choice(games: DataFrame, covered: DataFrame) -> DataFrame:
    """The latest playoff game decided by one goal that has events, else the latest playoff game with events. One row."""
    close = F.abs(F.col("home_score") - F.col("away_score")) <= 1
    rows = games.filter(is_completed(F.col("game_state")) & (F.col("game_type") == PLAYOFF)).join(
        covered.select("game_id").distinct(), "game_id", "left_semi"
    )
    return rows.withColumn("close", close).orderBy(F.col("close").desc(), F.col("game_date").desc(), F.col("game_id").desc()).limit(1)


def first_seen(games: DataFrame, columns: list[str]) -> DataFrame:
    """Each team's attributes from the first game that mentions it (home before away on one row)."""

    def side(team: str, at: int) -> Column:
        return F.struct(F.col(f"{team}_team").alias("team"), F.lit(at).alias("at"), *[F.col(f"{team}_{c}").alias(c) for c in columns])

    rows = games.select("game_date", "game_id", F.explode(F.array(side("home", 0), side("away", 1))).alias("s"))
    first = F.min_by(F.struct(*[F.col(f"s.{c}").alias(c) for c in columns]), F.struct("game_date", "game_id", "s.at"))
    return rows.groupBy(F.col("s.team").alias("team")).agg(first.alias("d")).select("team", "d.*")


def wanted_games(games: DataFrame, today: str, days_ahead: int, stretch_days: int = 5) -> DataFrame:
    """Unfinished games from today to the horizon; with none, the first slate after it and the five days following."""
    day = F.lit(today).cast("date")
    scheduled = games.filter(~is_completed(F.col("game_state")) & (F.col("game_date") >= day))
    first = scheduled.agg(F.min("game_date")).scalar()
    horizon = F.date_add(day, days_ahead)
    until = F.when(first > horizon, F.date_add(first, stretch_days)).otherwise(horizon)
    return scheduled.filter(F.col("game_date") <= until)


def finished_since(games: DataFrame, today: str, days: int) -> DataFrame:
    return games.filter(is_completed(F.col("game_state")) & (F.col("game_date") >= F.date_sub(F.lit(today).cast("date"), days)))


def pair_join(preds: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Predictions joined to fixtures on the pair of teams alone; a fixture met several times keeps its first prediction.

    A pair that plays often fans out, so the predictions are reduced to the
    first per pair before the join; the result is the same as de-duplicating after it.
    """
    first = preds.groupBy("home_team", "away_team").agg(F.min_by(F.struct("p", "pred_id"), F.col("pred_id")).alias("f"))
    return fixtures.join(first.select("home_team", "away_team", "f.*"), ["home_team", "away_team"])
