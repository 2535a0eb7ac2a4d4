"""Win-probability models on Spark ML: members, ensemble, walk-forward runs and the correction study."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contest import NEUTRAL_PRIOR, score_per_root_time
from ..functions.numbers import logit, round_even
from ..session import materialise
from . import scores

# fixed values: columns that are never inputs
NOT_FEATURES = (
    "game_id", "season", "game_type", "game_date", "start_time_utc", "venue", "home_team", "away_team", "home_score",
    "away_score", "winner_team", "target_home_win", "home_last_starting_goalie_id", "home_last_starting_goalie_name",
    "away_last_starting_goalie_id", "away_last_starting_goalie_name",
    "y",
)
# fixed values: settings of the members
LOGISTIC_C = 0.05
BOOSTED = {"stepSize": 0.03, "maxDepth": 4, "minInstancesPerNode": 80, "seed": 7}
SECOND_BOOSTED = {"stepSize": 0.03, "maxDepth": 4, "minInstancesPerNode": 1, "subsamplingRate": 0.8, "seed": 7}
LIVE_BOOSTED = {"stepSize": 0.06, "maxDepth": 5, "minInstancesPerNode": 200, "seed": 7}
MIN_TRAIN = 2000
# fixed values: inputs of the in-game model
LIVE_FEATURES = (
    "period", "seconds_remaining_regulation", "seconds_remaining_game", "game_progress", "score_diff_home", "abs_score_diff",
    "home_score", "away_score", "score_diff_per_sqrt_time", "sog_diff_home", "shot_attempt_diff_home", "home_sog", "away_sog",
    "manpower_diff_home", "home_power_play", "away_power_play", "even_strength", "home_active_penalty_seconds",
    "away_active_penalty_seconds", "home_empty_net", "away_empty_net", "home_power_play_opportunities",
    "away_power_play_opportunities", "home_power_play_goals", "away_power_play_goals", "faceoff_win_diff_home", "hit_diff_home",
    "home_takeaways", "away_takeaways", "home_giveaways", "away_giveaways", "home_goalie_save_pct_live",
    "away_goalie_save_pct_live", "home_goalie_saves", "away_goalie_saves", "pregame_home_prob", "is_playoff",
)


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that may be inputs, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES]


def mirrored(columns: list[str], recomputed: tuple[str, ...] = ()) -> list[str]:
    """Names that exist for both sides, without their prefix and without those computed afresh."""
    sides = [{c[5:] for c in columns if c.startswith(f"{s}_")} for s in ("home", "away")]
    return sorted((sides[0] & sides[1]) - set(recomputed))


def _inputs(features: list[str]) -> list:
    """Missing values become the column's median."""
    filled = [f"{c}__f" for c in features]
    return [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw")]


def _doubles(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features})


def logistic_member(features: list[str], rows: int, label: str = "y") -> Pipeline:
    """Median fill, standard scale, L2. A penalty of ``1/C`` on the summed loss is ``1/(C n)`` on the mean loss."""
    return Pipeline(
        stages=[
            *_inputs(features),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
            LogisticRegression(
                featuresCol="scaled", labelCol=label, regParam=1.0 / (LOGISTIC_C * max(rows, 1)), elasticNetParam=0.0,
                standardization=False, maxIter=200, probabilityCol="prob",
            ),
        ]
    )


def boosted_member(features: list[str], settings: dict, rounds: int, label: str = "y") -> Pipeline:
    """Gradient-boosted trees; the trees here need filled values and know no monotone constraints."""
    trees = GBTClassifier(featuresCol="raw", labelCol=label, maxIter=rounds, **settings).setProbabilityCol("prob")
    return Pipeline(stages=[*_inputs(features), trees])


def default_members(features: list[str], rows: int, rounds: int = 400, second_rounds: int = 600) -> dict[str, Pipeline]:
    return {
        "hgb": boosted_member(features, BOOSTED, rounds),
        "logit": logistic_member(features, rows),
        "catboost": boosted_member(features, SECOND_BOOSTED, second_rounds),
    }


def probability(model: Transformer, df: DataFrame, out: str, keep: list[str] | None = None) -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("prob")[1])
    return scored.select(*(keep or df.columns), out)


def ensemble(members: dict[str, PipelineModel], df: DataFrame, features: list[str] = (), out: str = "p_home") -> DataFrame:
    """Each member's probability as ``p_<name>`` and their plain mean."""
    rows = _doubles(df, list(features))
    for name, model in members.items():
        rows = probability(model, rows, f"p_{name}")
    mean = reduce(lambda a, b: a + b, [F.col(f"p_{n}") for n in members]) / len(members)
    return rows.withColumn(out, mean)


def fit_all(members: dict[str, Pipeline], train: DataFrame, features: list[str]) -> dict[str, PipelineModel]:
    """Fit every member; the training rows are written once, because each fit reads them many times."""
    rows = materialise(_doubles(train, features), "train")
    return {name: pipeline.fit(rows) for name, pipeline in members.items()}


def walk_forward(
    df: DataFrame,
    features: list[str],
    test_seasons: list[int],
    members: Callable[[list[str], int], dict[str, Pipeline]],
    burn_in: int = 0,
    min_train: int = MIN_TRAIN,
) -> DataFrame:
    """Predictions for each month of the test seasons from models trained on strictly earlier months.

    Columns: ids, outcome, ``elo_prob_home`` if present, each member and their
    mean. The data set is written once, so folds read columns instead of
    recomputing features; a fold's rows are written as soon as they are scored.
    """
    used = materialise(_doubles(df.filter(F.col("season") >= burn_in), features), "walk-forward")
    per_month = (
        used.groupBy(F.trunc("game_date", "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("season").isin(*test_seasons)).alias("tested"))
        .orderBy("month")
        .collect()  # one row per calendar month
    )
    kept = [c for c in ("game_id", "season", "game_date", "game_type", "y", "elo_prob_home") if c in used.columns]
    out, seen = None, 0
    for row in per_month:
        if row["tested"] and seen >= min_train:
            start = F.lit(row["month"])
            train = used.filter(F.col("game_date") < start)
            test = used.filter((F.trunc("game_date", "month") == start) & F.col("season").isin(*test_seasons))
            fitted = {name: pipeline.fit(train) for name, pipeline in members(features, seen).items()}
            scored = ensemble(fitted, test)
            probs = [c for c in scored.columns if c.startswith("p_")]
            fold = materialise(scored.select(*kept, *probs), "fold")
            out = fold if out is None else out.unionByName(fold)
        seen += row["n"]
    if out is None:
        # no month has enough earlier games: the same columns without rows
        names = [*[f"p_{n}" for n in members(features, min_train)], "p_home"]
        out = used.limit(0).select(*kept, *[F.lit(None).cast("double").alias(n) for n in names])
    return out


# ---- in-game model ------------------------------------------------------------------------------------------------


def live_rows(state: DataFrame, priors: DataFrame) -> DataFrame:
    """State rows with the game's prior (.54 where it was never predicted) and the scaled score."""
    joined = state.join(priors.select("game_id", F.col("p_home").alias("pregame_home_prob")), "game_id", "left")
    return joined.withColumns(
        {
            "pregame_home_prob": F.coalesce("pregame_home_prob", F.lit(NEUTRAL_PRIOR)),
            "score_diff_per_sqrt_time": score_per_root_time(F.col("score_diff_home"), F.col("seconds_remaining_regulation")),
        }
    )


def fit_live(train: DataFrame, features: list[str], rounds: int = 500, label: str = "y") -> tuple[PipelineModel, Transformer]:
    """Boosted trees and an isotonic calibration fitted on their training probabilities."""
    rows = materialise(_doubles(train.select(label, *features), features), "live-train")
    trees = boosted_member(features, LIVE_BOOSTED, rounds, label).fit(rows)
    raw = probability(trees, rows, "p_raw", [label])
    iso = IsotonicRegression(featuresCol="p_raw", labelCol=label, predictionCol="p").fit(raw.withColumn(label, F.col(label).cast("double")))
    return trees, iso


def score_live(models: tuple[PipelineModel, Transformer], rows: DataFrame, features: list[str]) -> DataFrame:
    trees, iso = models
    return iso.transform(probability(trees, _doubles(rows, features), "p_raw", rows.columns))


# ---- correction study -----------------------------------------------------------------------------------------------


def _logits(df: DataFrame, parts: list[str]) -> DataFrame:
    return df.withColumns({f"x_{i}": logit(F.col(p)) for i, p in enumerate(parts)})


def fit_logits(train: DataFrame, parts: list[str], y: str = "y") -> tuple[list[float], float]:
    """Weights and bias of an unpenalised logistic model on the logits of the given probabilities."""
    names = [f"x_{i}" for i in range(len(parts))]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(_logits(train, parts).withColumn(y, F.col(y).cast("double")))
    model = LogisticRegression(labelCol=y, regParam=0.0, standardization=False, maxIter=500, tol=1e-12).fit(rows.select("features", y))
    return [float(w) for w in model.coefficients], float(model.intercept)


def blend(weights: list[float], bias: float, parts: list[str]) -> Column:
    z = F.lit(bias)
    for w, p in zip(weights, parts, strict=True):
        z = z + F.lit(w) * logit(F.col(p))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _two_scores(name: str, train: DataFrame, test: DataFrame, p: Column, y: str, fitted: dict[str, float]) -> DataFrame:
    """One study row: fitted values with the scores on both parts, out of one aggregation each."""
    row = None
    for part, df in (("train", train), ("held_out", test)):
        cols = scores.score_columns(F.col("p"), F.col(y))
        exact = F.avg(scores.log_loss_of(F.col("p"), F.col(y))).alias(f"{part}_exact")
        one = df.select(p.alias("p"), y).agg(*[c.alias(f"{part}_{n}") for n, c in cols.items()], exact)
        row = one if row is None else row.join(F.broadcast(one))  # one row each
    text = ", ".join(f"{k}={v:.4f}" for k, v in fitted.items())
    return row.select(F.lit(name).alias("candidate"), F.lit(text).alias("fitted"), "*")


def correction_study(preds: DataFrame, held_out: int, parts: list[str], p: str = "p_home", y: str = "y") -> DataFrame:
    """Four corrections tuned on the seasons before ``held_out`` and measured once on it, with a verdict each.

    The moving home rate starts cold on the held-out season.
    """
    train, test = preds.filter(F.col("season") < held_out), preds.filter(F.col("season") == held_out)
    rows = [_two_scores("Equal-weight ensemble", train, test, F.col(p), y, {})]

    (slope,), bias = fit_logits(train, [p], y)
    rows.append(_two_scores("Platt scaling", train, test, blend([slope], bias, [p]), y, {"slope": slope, "bias": bias}))

    best = scores.home_rate_grid(train, p, y).filter("best").first()
    window, strength = best["window"], best["strength"]
    rolled = [scores.rolling_home_rate(d.select("game_id", "game_date", p, y), (window,), y) for d in (train, test)]
    moved = scores.adapted(F.col(p), F.col(f"home_rate_{window}"), strength)
    rows.append(_two_scores("Adaptive home edge", *rolled, moved, y, {"window": window, "strength": strength}))

    for name, inputs in (("Fitted ensemble weights", parts), ("Fitted ensemble weights + Elo", [*parts, "elo_prob_home"])):
        weights, bias = fit_logits(train, inputs, y)
        fitted = dict(zip(inputs, weights, strict=True)) | {"bias": bias}
        rows.append(_two_scores(name, train, test, blend(weights, bias, inputs), y, fitted))
    report = reduce(DataFrame.unionByName, rows)
    base = report.filter(F.col("candidate") == "Equal-weight ensemble").select(F.col("held_out_exact").alias("_base"))
    delta = F.col("held_out_exact") - F.col("_base")
    verdict = scores.study_verdict(delta)
    both = report.join(F.broadcast(base))  # one row
    return both.select(
        *[c for c in report.columns if not c.endswith("_exact")], round_even(delta, 4).alias("log_loss_delta"),
        *[c.alias(n) for n, c in verdict.items()],
    )


def save_registry(members: dict[str, PipelineModel], features: list[str], states: DataFrame, path: str) -> None:
    """Store fitted members, the feature order and the team states below one folder."""
    for name, model in members.items():
        model.write().overwrite().save(f"{path}/model={name}")
    spark = states.sparkSession
    order = spark.createDataFrame([(i, c) for i, c in enumerate(features)], "at int, name string")
    order.write.mode("overwrite").parquet(f"{path}/features")
    states.write.mode("overwrite").parquet(f"{path}/states")


def load_registry(spark, names: list[str], path: str) -> tuple[dict[str, PipelineModel], list[str], DataFrame]:
    members = {n: PipelineModel.load(f"{path}/model={n}") for n in names}
    features = [r["name"] for r in spark.read.parquet(f"{path}/features").orderBy("at").collect()]
    return members, features, spark.read.parquet(f"{path}/states")


def publish(members: dict[str, PipelineModel], features: list[str], spark, path: str, version: int) -> None:
    """Store fitted members under a version; the version is listed last, so a reader never meets half a model."""
    for name, model in members.items():
        model.write().overwrite().save(f"{path}/version-{version}/model={name}")
    order = spark.createDataFrame([(i, c) for i, c in enumerate(features)], "at int, name string")
    order.write.mode("overwrite").parquet(f"{path}/version-{version}/features")
    spark.createDataFrame([(version, sorted(members))], "version long, members array<string>").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def load_version(spark, path: str, version: int | None = None) -> tuple[dict[str, PipelineModel], list[str], int]:
    """Members, feature order and number of a published version; the newest, if none is named."""
    listed = spark.read.schema("version long, members array<string>").parquet(f"{path}/versions")
    if version is not None:
        listed = listed.filter(F.col("version") == version)
    row = listed.orderBy(F.col("version").desc()).first()
    if row is None:
        raise ValueError(f"no version {version or ''} below {path}")
    at = f"{path}/version-{row['version']}"
    features = [r["name"] for r in spark.read.schema("at int, name string").parquet(f"{at}/features").orderBy("at").collect()]
    return {n: PipelineModel.load(f"{at}/model={n}") for n in row["members"]}, features, row["version"]
