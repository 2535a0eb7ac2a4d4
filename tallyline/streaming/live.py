"""Structured Streaming over play events and finished games."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.contest import NEUTRAL_PRIOR, is_completed
from ..operators import ratings
from ..session import materialise, remove_folder, scratch_path

# the driver's streaming runner is a process of its own that has no shipped files: the processor goes to it by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """A file stream over the parquet files of a folder whose names match ``files``."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", files)
    return reader.parquet(folder)


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Play events as a stream; ``ts`` becomes a timestamp that watermarks accept."""
    return read_stream(spark, folder, schema, files, per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(writer, label: str, spark: SparkSession, progress: str | None = None) -> None:
    """Run a stream over what is there now. A run with the ``progress`` folder of an earlier one goes on where that one ended."""
    query = writer.option("checkpointLocation", progress or scratch_path(spark, f"progress-{label}")).trigger(availableNow=True).start()
    query.awaitTermination()


# ---- keyed state per game -----------------------------------------------------------------------------------------

# fixed values: counters of the streamed state
COUNTED = ("score", "sog", "shot_attempts", "penalties", "penalty_minutes", "faceoff_wins")
NAMES = tuple(f"{s}_{c}" for s in ("home", "away") for c in COUNTED)
STATE_OUT = T.StructType(
    [T.StructField("game_id", T.LongType()), T.StructField("event_index", T.LongType()), T.StructField("event_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in NAMES]
)
_EVENT = T.StructType(
    [
        T.StructField("ts", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("side", T.StringType()), T.StructField("penalty_minutes", T.LongType()),
    ]
)


def count_event(state: list[int], event: tuple) -> None:
    """Add one event to ``[index, last id, *counters]``."""
    _, event_id, kind, side, minutes = event
    state[0] += 1
    state[1] = event_id
    if side not in ("home", "away"):
        return
    hit = {
        "goal": ("score", "sog", "shot_attempts"), "shot-on-goal": ("sog", "shot_attempts"), "missed-shot": ("shot_attempts",),
        "blocked-shot": ("shot_attempts",), "penalty": ("penalties",), "faceoff": ("faceoff_wins",),
    }.get(kind, ())
    for counter in hit:
        state[2 + NAMES.index(f"{side}_{counter}")] += 1
    if kind == "penalty":
        state[2 + NAMES.index(f"{side}_penalty_minutes")] += int(minutes or 0)


class GameState(StatefulProcessor):
    """Current state per game.

    Events older than the watermark are folded into the counters and dropped;
    younger ones are kept, so a play that arrives late but in time is put in
    its place and every later row is recomputed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        folded = T.StructType([T.StructField("event_index", T.LongType()), T.StructField("event_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in NAMES])
        self.folded = handle.getValueState("folded", folded)
        self.open = handle.getListState("open", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.folded.get()) if self.folded.exists() else [0, None] + [0] * len(NAMES)
        events = [tuple(e) for e in self.open.get()] if self.open.exists() else []
        for frame in rows:
            stamps = (frame["ts"].astype("datetime64[us]").astype("int64")).tolist()
            minutes = [None if pd.isna(m) else int(m) for m in frame["penalty_minutes"].tolist()]
            events += zip(stamps, frame["event_id"].tolist(), frame["event_type"].tolist(), frame["side"].tolist(), minutes, strict=True)
        events.sort(key=lambda e: (e[0], e[1]))
        bound = timerValues.getCurrentWatermarkInMs() * 1000
        settled = [e for e in events if e[0] < bound]
        for event in settled:
            count_event(state, event)
        self.folded.update(tuple(state))
        kept = events[len(settled):]
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
        current = list(state)
        for event in kept:
            count_event(current, event)
        yield pd.DataFrame([[key[0], *current]], columns=[f.name for f in STATE_OUT.fields])

    def close(self) -> None:
        pass


def game_states(events: DataFrame) -> DataFrame:
    """A row per game and micro-batch with the game's state so far."""
    keyed = events.withWatermark("ts", WATERMARK).select(
        F.col("game_id").cast("long"), "ts", F.col("event_id").cast("long"), "event_type", "side", F.col("penalty_minutes").cast("long")
    )
    return keyed.groupBy("game_id").transformWithStateInPandas(
        GameState(), outputStructType=STATE_OUT, outputMode="Update", timeMode="EventTime"
    )


def latest_game_states(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Run the keyed state over what is there now and return the last state of each game."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = scratch_path(spark, "game-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(game_states(events).writeStream.outputMode("update").foreachBatch(keep), "game-state", spark)
    rows = spark.read.schema(STATE_OUT).parquet(out)
    newest = rows.groupBy("game_id").agg(F.max_by(F.struct("event_id", *NAMES), "event_index").alias("s"), F.max("event_index").alias("event_index"))
    return newest.select("game_id", "event_index", "s.*")


# ---- late plays, live scoring ------------------------------------------------------------------------------------


def windowed_plays(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Plays per event-time window and type; a window is final once the watermark has passed it."""
    grouped = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "event_type").agg(
        F.count(F.lit(1)).alias("plays"), F.sum("value").alias("value")
    )
    return grouped.select(F.col("window.start").alias("starts"), "event_type", "plays", "value")


def closed_windows(spark: SparkSession, events: DataFrame, width: str = "1 hour") -> DataFrame:
    made = windowed_plays(events, width)
    out = scratch_path(spark, "windows")
    run_available(made.writeStream.outputMode("append").format("parquet").option("path", out), "windows", spark)
    return spark.read.schema(made.schema).parquet(out)


def attach_prior(events: DataFrame, priors: DataFrame) -> DataFrame:
    """Stream-static join: each event with its game's prior, neutral where the game was never predicted."""
    known = priors.select("game_id", F.col("p_home").alias("prior"))
    return events.join(known, "game_id", "left").withColumn("prior", F.coalesce("prior", F.lit(NEUTRAL_PRIOR)))


def scored_events(spark: SparkSession, events: DataFrame, priors: DataFrame, score) -> DataFrame:
    """Score events as they come: ``score(batch)`` is applied per micro-batch and appended under its number."""
    out = scratch_path(spark, "scored")

    def keep(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(attach_prior(events, priors).writeStream.foreachBatch(keep), "scored", spark)
    return spark.read.parquet(out).drop("batch")


# ---- rating catch-up ---------------------------------------------------------------------------------------------


# dated snapshots of a pool that a late game can be re-folded from; before the oldest one, its games are folded anew
SNAPSHOTS = 8
# days before a pool's latest game that its snapshots reach back to, each four times as far as the one before
_REACH = tuple(4**k - 1 for k in range(9))


def _thinned(dates: DataFrame, snapshots: int) -> DataFrame:
    """Of each pool's dates the latest, and of each span of days before it that ``_REACH`` ends the earliest: the one that gets old soonest."""
    pool = Window.partitionBy("pool")
    age = F.datediff(F.max("as_of").over(pool), F.col("as_of"))
    span = sum((F.when(F.col("_age") > r, 1).otherwise(0) for r in _REACH), F.lit(0))
    earliest = F.row_number().over(Window.partitionBy("pool", "_span").orderBy("as_of"))
    rows = dates.withColumn("_age", age).withColumn("_span", span).filter(F.col("_span") < snapshots)
    return rows.withColumn("_nth", earliest).filter(F.col("_nth") == 1).drop("_age", "_span", "_nth")


def rating_stream(spark: SparkSession, games: DataFrame, out: str | None = None, progress: str | None = None, snapshots: int = SNAPSHOTS) -> DataFrame:
    """Keep team states up to date from a stream of games that may come late, out of order or again.

    Every micro-batch logs its finished games under its number, without those
    logged before (by id, not by date: the second half of a date is new). A
    version of the states holds each pool as of several dates, close to its
    latest game and ever further back. Snapshots of a pool dated on or after its
    earliest new game are void; the newest of the others is folded on with all
    logged games after it, once, and leaves the new snapshots on its way. So a
    late game costs a fold from a little before its date, and the states are
    always those of a whole replay. A batch that runs again reads the version
    before it and writes to the same place. With ``out`` and ``progress`` of an
    earlier run the stream resumes.
    """
    out = out or scratch_path(spark, "ratings")

    def fold(batch: DataFrame, batch_id: int) -> None:
        logged = T.StructType([*batch.schema.fields, T.StructField("batch", T.IntegerType())])
        fresh = batch.filter(is_completed(F.col("game_state"))).dropDuplicates(["game_id"])
        if batch_id > 0:
            known = spark.read.schema(logged).parquet(f"{out}/games").filter(F.col("batch") < batch_id)
            fresh = fresh.join(known.select("game_id"), "game_id", "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{out}/games/batch={batch_id}")
        log = spark.read.schema(logged).parquet(f"{out}/games").filter(F.col("batch") <= batch_id)
        # a game without a date comes before all others, so it voids every snapshot
        day = F.coalesce("game_date", F.lit("0001-01-01").cast("date"))
        earliest = log.filter(F.col("batch") == batch_id).groupBy("pool").agg(F.min(day).alias("_first"))
        due = log.drop("batch").join(earliest, "pool")
        states, valid = None, None
        if batch_id > 0:
            before = spark.read.parquet(f"{out}/states/batch={batch_id - 1}").join(earliest, "pool", "left")
            valid = before.filter(F.col("_first").isNull() | (F.col("as_of") < F.col("_first")))
            base = valid.filter(F.col("_first").isNotNull()).groupBy("pool").agg(F.max("as_of").alias("_base"))
            states = valid.join(base, "pool").filter(F.col("as_of") == F.col("_base")).drop("_base", "_first", "as_of")
            due = due.join(base, "pool", "left").filter(F.col("_base").isNull() | (F.col("game_date") > F.col("_base"))).drop("_base")
        due = due.drop("_first")
        spans = materialise(due.groupBy("pool").agg(F.min("game_date").alias("_from"), F.max("game_date").alias("_to")), "rating-spans")
        reach = F.explode(F.array(*[F.lit(r) for r in _REACH[:snapshots]]))
        made = spans.withColumn("_age", reach).withColumn("as_of", F.date_sub("_to", F.col("_age"))).filter(F.col("as_of") >= F.col("_from"))
        dates = made.select("pool", "as_of", (F.col("_age") == 0).alias("_last"))
        if valid is not None:
            dates = dates.unionByName(valid.select("pool", "as_of").distinct().withColumn("_last", F.lit(None).cast("boolean")))
        kept = _thinned(dates, snapshots)
        held = ratings.dated_states(due, states, kept.filter(~F.col("_last"))).filter(F.col("as_of").isNotNull())
        if valid is not None:
            held = held.unionByName(valid.drop("_first").join(kept.select("pool", "as_of"), ["pool", "as_of"], "left_semi"))
        held.write.mode("overwrite").parquet(f"{out}/states/batch={batch_id}")
        if batch_id > 1:
            remove_folder(spark, f"{out}/states/batch={batch_id - 2}")

    run_available(games.writeStream.foreachBatch(fold), "ratings", spark, progress)
    versions = spark.read.parquet(f"{out}/states")
    newest = versions.agg(F.max("batch").alias("batch"))
    latest = versions.join(F.broadcast(newest), "batch", "left_semi")  # one row
    day = latest.groupBy("pool").agg(F.max("as_of").alias("as_of"))
    return latest.join(day, ["pool", "as_of"], "left_semi").drop("batch", "as_of")
