"""Registered queries that fit boosted trees with missing values and monotone inputs."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from ..functions import contest
from ..operators import boosting, live, models
from ..session import materialise
from ..sources import standin
from .catalog_streams import model_rows

# fixed values: the in-game model's rising inputs and settings; trees of 31 leaves are grown five levels deep here
RISING = ("score_diff_home", "score_diff_per_sqrt_time", "pregame_home_prob", "sog_diff_home")
LIVE = boosting.Settings(rounds=500, step=0.06, depth=5, least_rows=200, l2=2.0, monotone=dict.fromkeys(RISING, 1))


def boosted_live_model(spark, folder):
    """In-game probabilities of the last finished season by trees fitted on all seasons before it, raw and calibrated.

    A tenth of the earlier games, by a hash of their ids, tells when to stop.
    """
    # every scan below reads its input twice, and scans read scans
    plays = materialise(standin.detailed_plays(spark, folder).drop("fed_at", "fed_second"), "live-plays")
    events = live.GameEvents(plays)
    state = live.running_state(events).join(live.active_penalties(events), ["game_id", "event_index"])
    preds = standin.predictions(spark, folder)
    known = preds.filter(contest.is_completed(F.col("game_state"))).select("game_id", "y", "season")
    features = list(models.LIVE_FEATURES)
    rows = model_rows(state, preds).join(known, "game_id").select("game_id", "event_id", "season", "y", *[F.col(c).cast("double").alias(c) for c in features])
    rows = materialise(rows, "live-rows")
    last = rows.agg(F.max("season").alias("_last"))
    rows = rows.join(F.broadcast(last))  # one row
    train = rows.filter(F.col("season") < F.col("_last"))
    made = boosting.fit(train, features, settings=LIVE, held_out=F.pmod(F.xxhash64("game_id"), F.lit(10)) == 0)
    raw = materialise(train.select("y", made.probability().alias("p_raw")), "live-raw").withColumn("y", F.col("y").cast("double"))
    iso = IsotonicRegression(featuresCol="p_raw", labelCol="y", predictionCol="p").fit(raw)
    tested = rows.filter(F.col("season") == F.col("_last")).select("game_id", "event_id", "y", made.probability().alias("p_raw"))
    return iso.transform(tested).select("game_id", "event_id", "y", "p_raw", "p")


QUERIES = {"boosted_live_model": (boosted_live_model, None)}
