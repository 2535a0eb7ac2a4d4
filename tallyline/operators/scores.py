"""Scoring probabilities against outcomes: accuracy, log loss, calibration, drift, boards of models.

Everything is a map-side combinable aggregation over (probability, outcome)
columns; ordered parts go through the blocked scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contest import confidence, is_completed, is_right
from ..functions.numbers import clamp, logit, ratio, round_even, sigmoid
from ..plans.scan import blocked, id_block, running_sum, with_halo, without_halo

# fixed values: sample sizes, drift limits and bands
MIN_SAMPLE = 30
DRIFT_CONFIDENT = 100
PSI_STABLE, PSI_MODERATE = 0.10, 0.25
PSI_EDGES = (0.0, 0.35, 0.45, 0.5, 0.55, 0.65, 1.0)
CONFIDENCE_BUCKETS = ((0.5, 0.55), (0.55, 0.6), (0.6, 0.65), (0.65, 0.7), (0.7, 1.01))
THRESHOLDS = (0.50, 0.55, 0.58, 0.60, 0.62, 0.65, 0.70)
PHASES = (0.0, 0.2, 0.4, 0.6, 0.8, 0.95, 1.0)
TOLERANCE = 5.0
NOISE_FLOOR = 0.005
# fixed values: study of a moving home rate
ASSUMED_HOME_RATE = 0.544
GRID_WINDOWS = (100, 200, 300, 500, 800)
GRID_STRENGTHS = (0.25, 0.5, 0.75, 1.0)
# fixed values: models of the board, column -> label, in board order
MODEL_LABELS = {
    "p_home": "Ensemble",
    "p_logit": "Logistic Regression",
    "p_hgb": "Gradient Boosting",
    "p_catboost": "CatBoost",
    "elo_prob_home": "Elo Baseline",
}


def log_loss_of(p: Column, y: Column) -> Column:
    """Loss of one row, the probability clamped by 1e-15 on both sides."""
    q = clamp(p, 1e-15, 1 - 1e-15)
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def floored_log_loss_of(p: Column, y: Column) -> Column:
    """Loss of one row, each logarithm's argument kept at 1e-9 or more."""
    return F.when(p.isNotNull(), -(y * F.ln(F.greatest(p, F.lit(1e-9))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(1e-9)))))


def score_columns(p: Column, y: Column) -> dict[str, Column]:
    right = F.when(is_right(p, y), 1).otherwise(0)
    return {
        "games": F.count(F.lit(1)),
        "accuracy": round_even(100 * F.avg(right), 1),
        "brier": round_even(F.avg((p - y) * (p - y)), 4),
        "log_loss": round_even(F.avg(log_loss_of(p, y)), 4),
    }


def score(df: DataFrame, p: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    made = [c.alias(n) for n, c in score_columns(F.col(p), F.col(y)).items()]
    out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    return out.withColumn("baseline_log_loss", F.lit(round(0.6931471805599453, 4)))


def to_long(df: DataFrame, columns: list[str], carry: list[str]) -> DataFrame:
    """One row per (row, model): columns ``model`` and ``p``."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return df.selectExpr(*carry, f"stack({len(columns)}, {pairs}) AS (model, p)")


def auc(long: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Exact area under the ROC curve per key, ties at half; null with one class only.

    Rows collapse to distinct probabilities first; the negatives below each
    come from a scan in bands of probability.
    """
    counts = long.groupBy(*keys, "p").agg(
        F.sum(F.when(F.col("y") == 1, 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col("y") == 1, 0.0).otherwise(1.0)).alias("neg"),
    )
    ranked = blocked(counts, keys, {"band": F.floor(F.col("p") * 4096)}, [F.col("p")], [running_sum("upto", F.col("neg"))])
    area = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(round_even(F.try_divide(area, F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def reliability_curve(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Confidence folded to .5 … 1 in equal bands; empty bands are kept.

    Every band row starts at zero games, so a band without data still shows:
    the bands ride along as zero-weight rows of the same aggregation.
    """
    prob, out = F.col(p), F.col(y)
    sure = F.when(prob >= 0.5, prob).otherwise(1 - prob)
    band = F.least(F.greatest(F.floor((sure - 0.5) / 0.5 * bins), F.lit(0)), F.lit(bins - 1)).cast("long")
    rows = df.select(*keys, band.alias("band"), sure.alias("c"), F.when(is_right(prob, out), 1).otherwise(0).alias("r"), F.lit(1).alias("w"))
    spark = df.sparkSession
    empty = [F.lit(0.0).alias("c"), F.lit(0).alias("r"), F.lit(0).alias("w")]
    if keys:
        seen = df.select(*keys).distinct()
        frame = seen.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<long>")).alias("band"), *empty)
    else:
        frame = spark.range(bins).select(F.col("id").alias("band"), *empty)
    per = rows.unionByName(frame).groupBy(*keys, "band").agg(
        F.sum("w").alias("games"), F.sum("c").alias("c"), F.sum("r").alias("r")
    )
    predicted = 100 * F.try_divide(F.col("c"), F.col("games"))
    actual = 100 * F.try_divide(F.col("r").cast("double"), F.col("games"))
    width = 50 / bins
    low = F.lit(50.0) + F.col("band") * width
    label = F.concat(F.rint(low).cast("int").cast("string"), F.lit("-"), F.rint(low + width).cast("int").cast("string"), F.lit("%"))
    return per.select(
        *keys,
        "band",
        label.alias("range"),
        "games",
        round_even(predicted, 1).alias("predicted"),
        round_even(actual, 1).alias("actual"),
        round_even(actual - predicted, 1).alias("gap"),
    )


def calibration_error(curve: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Games-weighted mean of the absolute *rounded* gaps; null without games."""
    made = round_even(F.try_divide(F.sum(F.col("games") * F.abs("gap")), F.sum("games")), 2).alias("ece")
    return curve.groupBy(*keys).agg(made) if keys else curve.agg(made)


def band_of(p: Column, edges: tuple[float, ...] = PSI_EDGES) -> Column:
    """Band index by lower edge; the last band takes everything above, values below the first edge none."""
    out = None
    for i in range(len(edges) - 2, -1, -1):
        hit = p >= edges[i]
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def shares(df: DataFrame, p: str, keys: tuple[str, ...], edges: tuple[float, ...] = PSI_EDGES) -> DataFrame:
    """Share of rows per band as columns ``s0`` … one row per key; zeros if nothing falls into a band."""
    band = band_of(F.col(p), edges)
    n = F.count(band)
    cols = [
        F.coalesce(F.try_divide(F.sum(F.when(band == i, 1.0).otherwise(0.0)), n.cast("double")), F.lit(0.0)).alias(f"s{i}")
        for i in range(len(edges) - 1)
    ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *cols) if keys else df.agg(F.count(F.lit(1)).alias("n"), *cols)


def psi(reference: DataFrame, current: DataFrame, p: str = "p", edges: tuple[float, ...] = PSI_EDGES) -> DataFrame:
    """One row: sizes of both samples and the population stability index, null if either is empty."""
    return psi_of(reference.select(F.lit(0).alias("now"), p).unionByName(current.select(F.lit(1).alias("now"), p)), p, edges)


def psi_of(tagged: DataFrame, p: str = "p", edges: tuple[float, ...] = PSI_EDGES, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same for rows tagged 0 (reference) or 1 (current) in ``now``, per key, out of one aggregation."""
    band = band_of(F.col(p), edges)
    now = F.col("now") == 1
    per_band = {}
    for i in range(len(edges) - 1):
        per_band[f"a{i}"] = F.sum(F.when(now & (band == i), 1.0).otherwise(0.0))
        per_band[f"e{i}"] = F.sum(F.when(~now & (band == i), 1.0).otherwise(0.0))
    counts = tagged.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~now, 1).otherwise(0)), F.lit(0)).alias("reference_games"),
        F.coalesce(F.sum(F.when(now, 1).otherwise(0)), F.lit(0)).alias("current_games"),
        F.sum(F.when(~now & band.isNotNull(), 1.0).otherwise(0.0)).alias("ref_in"),
        F.sum(F.when(now & band.isNotNull(), 1.0).otherwise(0.0)).alias("cur_in"),
        *[c.alias(n) for n, c in per_band.items()],
    )
    # an empty band gets a floor that is small but keeps the logarithm finite
    floor = 0.5 / F.greatest("reference_games", "current_games")
    total = F.lit(0.0)
    for i in range(len(edges) - 1):
        a = F.greatest(F.coalesce(F.try_divide(f"a{i}", "cur_in"), F.lit(0.0)), floor)
        e = F.greatest(F.coalesce(F.try_divide(f"e{i}", "ref_in"), F.lit(0.0)), floor)
        total = total + (a - e) * F.ln(a / e)
    both = (F.col("reference_games") > 0) & (F.col("current_games") > 0)
    return counts.select(*keys, "reference_games", "current_games", F.when(both, round_even(total, 4)).alias("psi"))


def drift_verdict(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unknown").when(value < PSI_STABLE, "stable").when(value < PSI_MODERATE, "watch").otherwise("shifted")
    )


def drift_report(reference: DataFrame, current: DataFrame, p: str = "p") -> DataFrame:
    """PSI with its verdict; unknown below 30 rows on either side, provisional below 100 current rows."""
    base = psi(reference, current, p)
    enough = (F.col("current_games") >= MIN_SAMPLE) & (F.col("reference_games") >= MIN_SAMPLE)
    value = F.when(enough, F.col("psi"))
    thin = F.col("current_games") < DRIFT_CONFIDENT
    n = F.col("current_games").cast("string")
    note = (
        F.when(~enough, F.lit(f"too few games: {MIN_SAMPLE} are wanted in each sample"))
        .when(thin, F.concat(n, F.lit(" current games, a first reading")))
        .otherwise(F.concat(n, F.lit(" current games")))
    )
    return base.select(
        "reference_games",
        "current_games",
        value.alias("psi"),
        drift_verdict(value).alias("verdict"),
        F.when(~enough, True).otherwise(thin).alias("provisional"),
        note.alias("note"),
    )


def summarise(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Every calibration number of one sample; numbers are null below the minimum sample."""
    ece = calibration_error(reliability_curve(df, p, y))
    both = score(df, p, y).join(F.broadcast(ece))  # one row each
    enough = F.col("games") >= MIN_SAMPLE
    hidden = ("accuracy", "brier", "log_loss", "baseline_log_loss", "ece")
    return both.select("games", enough.alias("enough"), *[F.when(enough, F.col(c)).alias(c) for c in hidden])


def compare(live: DataFrame, reference: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Live accuracy against the reference's: one row out of two one-row summaries."""
    a = live.select(F.col("enough").alias("live_enough"), F.col("accuracy").alias("live_accuracy"), F.col("games").alias("live_games"))
    b = reference.select(
        F.col("enough").alias("ref_enough"), F.col("accuracy").alias("ref_accuracy"), F.col("games").alias("ref_games")
    )
    both = a.join(F.broadcast(b))  # one row each
    delta = F.when(F.col("live_enough") & F.col("ref_enough"), round_even(F.col("live_accuracy") - F.col("ref_accuracy"), 1))
    status = (
        F.when(delta.isNull(), "warming-up").when(delta < -tolerance, "below-baseline").when(delta > tolerance, "above-baseline").otherwise("on-track")
    )
    return both.select("live_games", "ref_games", "live_accuracy", "ref_accuracy", delta.alias("delta"), status.alias("status"))


def baseline_season(preds: DataFrame, settings: DataFrame, key: str = "baseline_season") -> Column:
    """The season stored under ``key`` in ``settings`` (key, value), else the first season with a final game.

    A value that is no number counts as absent; of several the largest is taken.
    """
    named = settings.filter(F.col("key") == key).agg(F.max(F.col("value").try_cast("bigint")).alias("season")).scalar()
    first = preds.filter(is_completed(F.col("game_state"))).agg(F.min("season").alias("season")).scalar()
    return F.coalesce(named, first)


def monitoring(rows: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The monitoring report as one row, out of rows tagged ``ref``, ``live`` or ``slate`` in ``section`` (with ``p`` and ``y``).

    Three keyed aggregations make scores, calibration and drift; the current
    sample of the drift is the slate, or the live games where there is none.
    """
    scored = score(rows, "p", "y", ("section",)).join(
        calibration_error(reliability_curve(rows, keys=("section",)), ("section",)), "section"
    )
    shown = ("games", "accuracy", "log_loss", "ece")
    one = scored.agg(*[F.max(F.when(F.col("section") == s, F.col(c))).alias(f"{s}_{c}") for s in ("ref", "live") for c in shown])
    beside = F.when(F.col("section") == "ref", F.array(F.lit("slate"), F.lit("live"))).otherwise(F.array("section"))
    drift = psi_of(rows.select(F.explode(beside).alias("beside"), (F.col("section") != "ref").cast("int").alias("now"), "p"), keys=("beside",))
    rank = F.when((F.col("beside") == "slate") & (F.col("current_games") > 0), 2).when(F.col("beside") == "live", 1).otherwise(0)
    drift = drift.agg(F.max_by(F.struct("psi", "current_games", "reference_games"), rank).alias("drift"))
    # two rows that know one half each
    both = one.unionByName(drift, allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    games = {s: F.coalesce(f"{s}_games", F.lit(0)) for s in ("ref", "live")}
    seen = lambda s, c: F.when(games[s] >= MIN_SAMPLE, F.col(f"{s}_{c}"))
    delta = round_even(seen("live", "accuracy") - seen("ref", "accuracy"), 1)
    status = F.when(delta.isNull(), "warming-up").when(delta < -tolerance, "below-baseline").when(delta > tolerance, "above-baseline").otherwise("on-track")
    now, then = F.col("drift.current_games"), F.col("drift.reference_games")
    value = F.when((now >= MIN_SAMPLE) & (then >= MIN_SAMPLE), F.col("drift.psi"))
    return row.select(
        games["live"].alias("live_games"), games["ref"].alias("ref_games"), seen("live", "accuracy").alias("live_accuracy"),
        seen("ref", "accuracy").alias("ref_accuracy"), delta.alias("delta"), status.alias("status"),
        *[seen(s, c).alias(f"{s}_{c}") for s in ("ref", "live") for c in ("ece", "log_loss")],
        value.alias("psi"), drift_verdict(value).alias("drift_verdict"), ((now < DRIFT_CONFIDENT) | (then < MIN_SAMPLE)).alias("provisional"),
        now.alias("drift_games"),
    )


def season_scorecard(df: DataFrame, p: str = "p_home", y: str = "y") -> DataFrame:
    """Scores per season and over all seasons (``ALL``), with mean, spread and the home rate."""
    prob, out = F.col(p), F.col(y)
    made = df.rollup("season").agg(
        *[c.alias(n) for n, c in score_columns(prob, out).items()],
        round_even(F.avg(prob), 3).alias("mean_prediction"),
        round_even(F.stddev_pop(prob), 3).alias("spread"),
        round_even(100 * F.avg(out), 1).alias("home_win_rate"),
    )
    return made.withColumn("season", F.coalesce(F.col("season").cast("string"), F.lit("ALL")))


def confidence_buckets(df: DataFrame, p: str = "p_home", y: str = "y") -> DataFrame:
    """Games and accuracy per confidence bucket; empty buckets do not appear."""
    sure = confidence(F.col(p))
    bucket = None
    for low, high in CONFIDENCE_BUCKETS:
        label = F.lit(f"{int(low * 100)}-{int(min(high, 1) * 100)}%")
        hit = (sure >= low) & (sure < high)
        bucket = F.when(hit, label) if bucket is None else bucket.when(hit, label)
    right = F.when(is_right(F.col(p), F.col(y)), 1).otherwise(0)
    return df.select(bucket.alias("range"), right.alias("r")).filter(F.col("range").isNotNull()).groupBy("range").agg(
        F.count(F.lit(1)).alias("games"), round_even(100 * F.avg("r"), 1).alias("accuracy")
    )


def threshold_report(df: DataFrame, p: str = "p_home", y: str = "y") -> DataFrame:
    """Coverage and hit rate of picks at least so confident, for seven thresholds, in one pass."""
    sure = confidence(F.col(p))
    right = is_right(F.col(p), F.col(y))
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(THRESHOLDS):
        aggs += [
            F.sum(F.when(sure >= t, 1).otherwise(0)).alias(f"n{i}"),
            F.sum(F.when((sure >= t) & right, 1).otherwise(0)).alias(f"h{i}"),
        ]
    rows = ", ".join(f"{t}D, n{i}, h{i}" for i, t in enumerate(THRESHOLDS))
    long = df.agg(*aggs).selectExpr("total", f"stack({len(THRESHOLDS)}, {rows}) AS (min_conf, picks, hits)")
    return long.filter("picks > 0").select(
        "min_conf",
        round_even(ratio(F.col("picks"), F.col("total")), 4).alias("coverage"),
        "picks",
        round_even(ratio(F.col("hits"), F.col("picks")), 4).alias("win_rate"),
    )


def monthly_accuracy(df: DataFrame, p: str = "p_home", y: str = "y") -> DataFrame:
    right = F.when(is_right(F.col(p), F.col(y)), 1).otherwise(0)
    return df.groupBy(F.date_format("game_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("games"), round_even(100 * F.avg(right), 1).alias("accuracy")
    )


def phase_buckets(df: DataFrame, p: str = "p", y: str = "y", progress: str = "game_progress") -> DataFrame:
    """Scores per phase of the game: right-closed buckets of progress; progress 0 falls into none."""
    x = clamp(F.col(progress), 0.0, 1.0)
    bucket = None
    for low, high in zip(PHASES[:-1], PHASES[1:], strict=True):
        hit = (x > low) & (x <= high)
        bucket = F.when(hit, F.lit(f"({low}, {high}]")) if bucket is None else bucket.when(hit, F.lit(f"({low}, {high}]"))
    rows = df.withColumn("phase", bucket).filter(F.col("phase").isNotNull())
    right = F.when(is_right(F.col(p), F.col(y)), 1).otherwise(0)
    made = rows.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"),
        round_even(F.avg(right), 4).alias("accuracy"),
        round_even(F.avg(log_loss_of(F.col(p), F.col(y))), 4).alias("log_loss"),
    )
    area = auc(rows.select("phase", F.col(p).alias("p"), F.col(y).alias("y")), ("phase",))
    return made.join(area, "phase", "left")


def _runs_after(rows: DataFrame, above: list[str], at: str, columns: list[str]) -> DataFrame:
    """Summaries of consecutive stretches (rows, first and last miss, longest run) put together in the order of ``at``."""
    before = Window.partitionBy(*above).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    missed = {c: F.max(F.col("_start") + F.col(f"_last_{c}")).over(before) for c in columns}
    rows = rows.select("*", *[v.alias(f"_before_{c}") for c, v in missed.items()])
    made = [F.sum("_n").alias("_n")]
    for c in columns:
        # the run that reaches into a stretch from the stretches before it
        reaching = F.col("_start") + F.coalesce(F.col(f"_first_{c}") - 1, F.col("_n")) - F.coalesce(f"_before_{c}", F.lit(0))
        made += [
            F.min(F.col("_start") + F.col(f"_first_{c}")).alias(f"_first_{c}"), F.max(F.col("_start") + F.col(f"_last_{c}")).alias(f"_last_{c}"),
            F.max(F.greatest(F.col(f"_best_{c}"), reaching)).alias(f"_best_{c}"),
        ]
    return rows.groupBy(*above).agg(*made)


def longest_runs(df: DataFrame, columns: list[str], y: str = "y") -> DataFrame:
    """Longest run of right picks per model (a column of probabilities) in (game_date, game_id) order.

    All models share the order, so the games are dealt and sorted once, with one
    flag per model. A block (ids of a day) then becomes one row: its games, the
    places of its first and last miss and its longest run. These rows are put
    together in order, first per day and then over the days.
    """
    missed = [F.when(is_right(F.col(c), F.col(y)), 0).otherwise(1).cast("tinyint").alias(f"_miss_{c}") for c in columns]
    rows = df.select(F.col("game_date").alias("_day"), id_block("game_id").alias("_ids"), F.col("game_id").alias("_id"), *missed)
    rows = rows.filter(F.col("_day").isNotNull() & F.col("_ids").isNotNull())
    inside = Window.partitionBy("_day", "_ids").orderBy("_id")
    rows = rows.withColumn("_at", F.row_number().over(inside).cast("long"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    miss_at = {c: F.when(F.col(f"_miss_{c}") == 1, F.col("_at")) for c in columns}
    rows = rows.select("*", *[(F.col("_at") - F.coalesce(F.max(v).over(upto), F.lit(0))).alias(f"_run_{c}") for c, v in miss_at.items()])
    made = [F.count(F.lit(1)).alias("_n")]
    for c, v in miss_at.items():
        made += [F.min(v).alias(f"_first_{c}"), F.max(v).alias(f"_last_{c}"), F.max(f"_run_{c}").alias(f"_best_{c}")]
    blocks = rows.groupBy("_day", "_ids").agg(*made)
    # one row per day, then one row
    whole = _runs_after(_runs_after(blocks, ["_day"], "_ids", columns), [], "_day", columns).filter(F.col("_n") > 0)
    pairs = ", ".join(f"'{c}', _best_{c}" for c in columns)
    return whole.selectExpr(f"stack({len(columns)}, {pairs}) AS (model, best_streak)")


def model_board(df: DataFrame, columns: dict[str, str], y: str = "y") -> DataFrame:
    """Accuracy, log loss, correct picks and best streak per model, ranked by accuracy; ties keep input order."""
    order = {c: i for i, c in enumerate(columns)}
    long = to_long(df, list(columns), [y, "game_date", "game_id"])
    p, out = F.col("p"), F.col(y)
    right = F.when(is_right(p, out), 1).otherwise(0)
    totals = long.groupBy("model").agg(
        round_even(100 * F.avg(right), 1).alias("accuracy"),
        round_even(F.avg(floored_log_loss_of(p, out)), 4).alias("log_loss"),
        F.sum(right).alias("correct_picks"),
        F.count(F.lit(1)).alias("games"),
    )
    both = totals.join(longest_runs(df, list(columns), y), "model")
    place = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    label = F.create_map(*[x for c, n in columns.items() for x in (F.lit(c), F.lit(n))])
    # one row per model
    rank = F.row_number().over(Window.orderBy(F.col("accuracy").desc(), place[F.col("model")]))
    return both.select(
        label[F.col("model")].alias("model"),
        "accuracy",
        "log_loss",
        "correct_picks",
        "games",
        "best_streak",
        rank.cast("long").alias("rank"),
    )


def rolling_home_rate(df: DataFrame, windows: tuple[int, ...], y: str = "y") -> DataFrame:
    """Mean of the previous ``w`` outcomes in (game_date, game_id) order per window; null until ``w`` are seen.

    The stream is numbered by a scan and cut into blocks of consecutive rows.
    Each block also receives the last rows of the block before it, so every
    frame lies inside one block.
    """
    numbered = blocked(
        df,
        [],
        {"day": F.col("game_date"), "ids": id_block("game_id")},
        [F.col("game_date"), F.col("game_id")],
        [running_sum("_n", F.lit(1)), running_sum("_s", F.col(y))],
    )
    # a frame's sum is the difference of two running totals, whatever its width
    spread = with_halo(numbered, "_n", max(windows) + 1)
    w = Window.partitionBy("_block").orderBy("_n")
    before = F.col("_s") - F.col(y)
    rates = {
        f"home_rate_{n}": F.when(F.col("_n") > n, (before - F.coalesce(F.lag("_s", n + 1).over(w), F.lit(0))) / F.lit(float(n)))
        for n in windows
    }
    return without_halo(spread.select("*", *[c.alias(n) for n, c in rates.items()])).drop("_n", "_s")


def adapted(p: Column, home_rate: Column, strength: float) -> Column:
    """The probability moved towards the recent home rate; unchanged while that is unknown."""
    shift = F.coalesce(strength * (logit(home_rate) - logit(F.lit(ASSUMED_HOME_RATE))), F.lit(0.0))
    return sigmoid(logit(p) + shift)


def home_rate_grid(df: DataFrame, p: str = "p_home", y: str = "y") -> DataFrame:
    """Log loss of every (window, strength), all from one pass; ``best`` marks the first smallest."""
    rolled = rolling_home_rate(df.select("game_id", "game_date", p, y), GRID_WINDOWS, y)
    base = logit(F.lit(ASSUMED_HOME_RATE))
    shifts = [F.coalesce(logit(F.col(f"home_rate_{w}")) - base, F.lit(0.0)).alias(f"s{w}") for w in GRID_WINDOWS]
    rates = ", ".join(f"{w}L, s{w}" for w in GRID_WINDOWS)
    rows = rolled.select(logit(F.col(p)).alias("z"), F.col(y).alias("y"), *shifts)
    rows = rows.selectExpr("z", "y", f"stack({len(GRID_WINDOWS)}, {rates}) AS (window, shift)")
    # the grid is a fixed list of twenty cells; its rows are aggregated where they arise
    strengths = F.array(*[F.lit(s) for s in GRID_STRENGTHS])
    rows = rows.select("z", "y", "window", "shift", F.explode(strengths).alias("strength"))
    moved = sigmoid(F.col("z") + F.col("strength") * F.col("shift"))
    loss = round_even(F.avg(log_loss_of(moved, F.col("y"))), 6)
    cells = rows.groupBy("window", "strength").agg(loss.alias("log_loss"))
    first = F.row_number().over(Window.orderBy("log_loss", "window", "strength")) == 1  # twenty rows
    return cells.withColumn("best", first).select("window", "strength", "log_loss", "best")


def study_verdict(delta: Column) -> dict[str, Column]:
    """Did a candidate help on held-out data by more than the noise floor?"""
    note = (
        F.when(delta < -NOISE_FLOOR, "held-out loss falls by more than chance explains")
        .when(delta > NOISE_FLOOR, "held-out loss rises by more than chance explains")
        .otherwise("held-out loss moves less than chance explains")
    )
    return {"helped": delta < -NOISE_FLOOR, "note": note}


def walk_forward_base_rate(df: DataFrame, y: str = "y", burn_in: int = 0, min_rows: int = 2000) -> DataFrame:
    """Per month the home rate of all games dated before it, where at least ``min_rows`` are known.

    Training windows only grow, so they are running totals over months rather
    than a range join of months and games.
    """
    used = df.filter(F.col("season") >= burn_in)
    month = F.trunc("game_date", "month")
    per_month = used.groupBy(month.alias("month_start")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("wins")
    )
    # one row per calendar month
    before = Window.orderBy("month_start").rowsBetween(Window.unboundedPreceding, -1)
    folds = per_month.select(
        "month_start", F.sum("n").over(before).alias("train_rows"), F.sum("wins").over(before).alias("train_wins")
    ).filter(F.col("train_rows") >= min_rows)
    return used.withColumn("month_start", month).join(
        folds.select("month_start", "train_rows", (F.col("train_wins") / F.col("train_rows")).alias("p_base")), "month_start"
    )
