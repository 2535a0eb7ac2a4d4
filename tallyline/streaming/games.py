"""Full in-game state as a stream: one final row per play, timers that settle plays and end games.

The processor keeps, per game, the state after every play the watermark has
passed (counters, stated scores, manpower, penalties, goalies) and the few plays
younger than the watermark. A play that arrives late but within the watermark is
put in its place before anything behind it is emitted, so every row is emitted
once and is final, and equals the row the batch operators make of the whole game.

Event-time timers do the rest without any further play: one settles waiting
plays as soon as the watermark passes them, one ends a game after ``idle`` without
plays and drops all its state. (Time-to-live of state values is measured in
processing time, which a replay does not follow; these timers are its event-time
form.) ``idle`` must be longer than any pause within a game.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import contest
from ..operators import live, models, penalty_box
from ..session import scratch_path
from .live import ROCKSDB, WATERMARK, run_available

# the driver's streaming runner is a process of its own that has no shipped files
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(penalty_box)

IDLE_MINUTES = 30
# fixed value: the kind of row that only moves time on
HEARTBEAT = "heartbeat"

SIDES = live.SIDES
COUNTERS = tuple(f"{s}_{n}" for n in live.COUNTERS for s, _ in SIDES)
SCORES = ("home_score", "away_score")
GOALIES = ("home_goalie_id", "away_goalie_id")
ON_GOAL, ATTEMPTS = tuple(contest.ON_GOAL), tuple(contest.LIVE_ATTEMPTS)
PENALTIES = live.PENALTY_COLUMNS

_LONG, _TEXT = T.LongType(), T.StringType()
# a play as it waits for the watermark; times in microseconds
PLAY = T.StructType([
    T.StructField("at", _LONG), T.StructField("sort_order", _LONG), T.StructField("event_id", _LONG), T.StructField("event_type", _TEXT), T.StructField("side", _TEXT),
    T.StructField("situation_code", _TEXT), T.StructField("edge", _TEXT), T.StructField("seconds_elapsed", _LONG), T.StructField("penalty_minutes", T.DoubleType()),
    T.StructField("goalie_in_net_id", _LONG), T.StructField("home_score_event", _LONG), T.StructField("away_score_event", _LONG),
])
_BOXES = ("home_minors", "home_longer", "away_minors", "away_longer")
HELD = T.StructType(
    [T.StructField("event_index", _LONG), T.StructField("latest", _LONG), T.StructField("edge", _TEXT)]
    + [T.StructField(n, _LONG) for n in (*COUNTERS, *SCORES, *GOALIES)]
    + [T.StructField(n, T.ArrayType(_LONG)) for n in _BOXES]
)
# all that is kept of a game is one value: reading and writing it is one call each, however many plays wait
KEPT = T.StructType([*HELD.fields, T.StructField("waiting", T.ArrayType(PLAY)), T.StructField("timer", _LONG)])
_SHOWN = ("event_id", "sort_order", "event_type", "side", "situation_code", "seconds_elapsed", "penalty_minutes")
ROW = T.StructType(
    [T.StructField("game_id", _LONG), T.StructField("event_index", _LONG)]
    + [PLAY[n] for n in _SHOWN]
    + [T.StructField(n, _LONG) for n in (*COUNTERS, *SCORES, *GOALIES, *PENALTIES)]
)
# A game's rows leave the processor as few columns, all whole numbers in one array: each column of each
# game costs a conversion of its own.
_TOLD = ("event_type", "side", "situation_code", "penalty_minutes")
_WHOLE = tuple(f.name for f in ROW.fields if f.name not in _TOLD)
PACKED = T.StructType([T.StructField("whole", T.ArrayType(_LONG)), *[ROW[n] for n in _TOLD]])


def unpacked(rows: DataFrame) -> DataFrame:
    """Packed rows with the columns of ``ROW``."""
    at = {n: i for i, n in enumerate(_WHOLE)}
    return rows.select(*[F.get("whole", F.lit(at[n])).alias(n) if n in at else F.col(n) for n in ROW.names])


class Game:
    """The state of one game after some plays."""

    def __init__(self, held: tuple | None = None):
        self.index, self.latest, self.edge = 0, 0, None
        self.n = dict.fromkeys((*COUNTERS, *SCORES), 0) | dict.fromkeys(GOALIES)
        self.boxes = penalty_box.boxes()
        if held is not None:
            self.index, self.latest, self.edge, *rest = held
            self.n = dict(zip((*COUNTERS, *SCORES, *GOALIES), rest, strict=False))
            for name, ends in zip(_BOXES, rest[len(self.n) :], strict=True):
                side, kind = name.split("_")
                for end in ends:
                    self.boxes[side].sit(end, kind == "minors")

    def held(self) -> tuple:
        waiting = [list(getattr(self.boxes[s], kind)) for s, kind in (name.split("_") for name in _BOXES)]
        return (self.index, self.latest, self.edge, *self.n.values(), *waiting)

    def play(self, p: dict) -> None:
        """Add one play."""
        self.index += 1
        self.latest = max(self.latest, p["at"])
        n, kind, side, edge = self.n, p["event_type"], p["side"], p["edge"]
        if edge is not None and edge != self.edge:
            n[f"{edge}_power_play_opportunities"] += 1
        self.edge = edge
        penalty_box.after_event(self.boxes, (None, None, None, kind, side, edge, p["seconds_elapsed"], p["penalty_minutes"]))
        if side not in ("home", "away"):
            return
        other = "away" if side == "home" else "home"
        plain = {"missed-shot": "missed_shots", "hit": "hits", "giveaway": "giveaways", "takeaway": "takeaways", "faceoff": "faceoff_wins", "penalty": "penalties"}
        if kind in plain:
            n[f"{side}_{plain[kind]}"] += 1
        if kind in ATTEMPTS:
            n[f"{side}_shot_attempts"] += 1
        if kind == "blocked-shot":
            n[f"{side}_blocked_shots_for"] += 1
            n[f"{other}_blocks"] += 1
        if kind == "penalty":
            n[f"{side}_penalty_minutes"] += int(p["penalty_minutes"] or 0)
        if kind in ON_GOAL:
            n[f"{side}_sog"] += 1
            n[f"{other}_goalie_goals_against" if kind == "goal" else f"{other}_goalie_saves"] += 1
            if p["goalie_in_net_id"]:
                n[f"{other}_goalie_id"] = p["goalie_in_net_id"]
        if kind == "goal":
            n[f"{side}_score"] = p[f"{side}_score_event"] or n[f"{side}_score"] + 1
            if p[f"{other}_score_event"] is not None:
                n[f"{other}_score"] = p[f"{other}_score_event"]
            if edge is not None:
                n[f"{side}_power_play_goals" if edge == side else f"{side}_short_handed_goals"] += 1

    def row(self, game_id: int, p: dict) -> tuple:
        (n_home, left_home), (n_away, left_away) = (self.boxes[s].report(p["seconds_elapsed"] or 0) for s in ("home", "away"))
        return (game_id, self.index, *[p[c] for c in _SHOWN], *self.n.values(), n_home, n_away, left_home, left_away)


class GameTracker(StatefulProcessor):
    """Settled state and waiting plays per game; see the module's text."""

    def __init__(self, idle_minutes: int = IDLE_MINUTES):
        self.idle = idle_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = []
        for frame in rows:
            columns = []
            for field in PLAY.fields:
                values = frame[field.name]
                kind = (lambda v: v) if field.dataType == _TEXT else float if field.name == "penalty_minutes" else int
                columns.append([None if pd.isna(v) else kind(v) for v in values.tolist()])
            arrived += zip(*columns, strict=True)
        yield from self.go_on(key, arrived, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.go_on(key, [], timerValues, expired=True)

    def go_on(self, key, arrived: list[tuple], timerValues, expired: bool = False) -> Iterator[pd.DataFrame]:
        bound = timerValues.getCurrentWatermarkInMs() * 1000
        kept = self.kept.get()
        *held, waiting, timer = tuple(kept) if kept is not None else (None, [], None)
        game = Game(tuple(held) if kept is not None else None)
        plays = sorted([tuple(p) for p in waiting] + arrived, key=lambda p: (p[0], p[1] or 0, p[2] or 0))
        done = [p for p in plays if p[0] < bound]
        out = []
        for p in done:
            named = dict(zip(PLAY.names, p, strict=True))
            if game.index and named["at"] > game.latest + self.idle:
                # the game had ended, whether or not a micro-batch came in between to tell
                game = Game()
            game.play(named)
            out.append(game.row(key[0], named))
        plays = plays[len(done) :]
        wake = None
        if plays or game.latest + self.idle >= bound:
            # past the oldest waiting play, or past the end of the game
            wake = max(plays[0][0] if plays else game.latest + self.idle, bound) // 1000 + 1
        # a timer that has run out is gone
        if timer is not None and timer != wake and not expired:
            self.handle.deleteTimer(timer)
        if wake is None:
            self.kept.clear()
        else:
            self.kept.update((*game.held(), plays, wake))
            if timer != wake or expired:
                self.handle.registerTimer(wake)
        if out:
            whole, told = ([ROW.names.index(n) for n in names] for names in (_WHOLE, _TOLD))
            columns = {"whole": [[row[i] for i in whole] for row in out]} | {n: [row[i] for row in out] for n, i in zip(_TOLD, told, strict=True)}
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in columns.items()})

    def close(self) -> None:
        pass


def state_stream(plays: DataFrame, idle_minutes: int = IDLE_MINUTES, delay: str = WATERMARK) -> DataFrame:
    """Final state rows of a stream of plays (the batch operators' columns and ``fed_at``, the time a play was made)."""
    # the condition names the event time, so the optimizer leaves it above the watermark, which heartbeats move
    plain = (F.col("event_type") != HEARTBEAT) | F.col("fed_at").isNull()
    rows = live.with_situation(live.GameEvents(plays.withWatermark("fed_at", delay)).plays).filter(plain)
    edge = contest.power_play_side(F.col("home_skaters"), F.col("away_skaters"))
    keyed = rows.select(
        F.col("game_id").cast("long").alias("game_id"), "fed_at", F.unix_micros("fed_at").alias("at"), edge.alias("edge"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PLAY.fields if f.name not in ("at", "edge")],
    )
    made = keyed.groupBy("game_id").transformWithStateInPandas(GameTracker(idle_minutes), outputStructType=PACKED, outputMode="Append", timeMode="EventTime")
    return unpacked(made)


def derived(rows: DataFrame) -> DataFrame:
    """Emitted rows with the columns that follow from them: manpower flags and differences."""
    return live.with_differences(live.with_situation(rows))


def run_states(spark: SparkSession, plays: DataFrame, each=None, idle_minutes: int = IDLE_MINUTES, out: str | None = None, progress: str | None = None) -> DataFrame:
    """Run the stream over what is there now; returns all rows emitted.

    ``each(rows)`` is applied to every micro-batch's rows before they are written under
    its number, so a batch that runs again writes to the same place. With
    ``out`` and ``progress`` of an earlier run the stream goes on where that one ended.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = out or scratch_path(spark, "state-rows")
    each = each or derived

    def keep(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(state_stream(plays, idle_minutes).writeStream.outputMode("append").foreachBatch(keep), "state-rows", spark, progress)
    return spark.read.parquet(out).drop("batch")


def run_scored(spark: SparkSession, plays: DataFrame, registry: str, prepare, version: int | None = None, **more) -> DataFrame:
    """State rows scored as they settle by a published model, with its version.

    The model is read once, when the stream starts, and serves all its
    micro-batches, so a stream is scored by one version. ``prepare(rows)`` adds the
    model's inputs (priors, clocks) to final state rows; several members are averaged.
    """
    members, features, number = models.load_version(spark, registry, version)

    def each(rows: DataFrame) -> DataFrame:
        scored = models.ensemble(members, prepare(derived(rows)), features, "p")
        return scored.withColumn("version", F.lit(number).cast("long"))

    return run_states(spark, plays, each, **more)


# ---- replays -------------------------------------------------------------------------------------------------------


# bytes of a row group of a replay's files
ROW_GROUP = 4 << 20


def write_parts(rows: DataFrame, folder: str, files: int, part: str = "part") -> None:
    """The rows of part 0, 1, … as files written one after another, in row groups that can be read by several tasks."""
    for i in range(files):
        rows.filter(F.col(part) == i).drop(part).coalesce(1).write.option("parquet.block.size", ROW_GROUP).parquet(f"{folder}/{part}-{i}")


def write_replay(plays: DataFrame, folder: str, files: int = 4, part: str = "part") -> None:
    """A replay of plays in parts, and last a heartbeat a day later.

    The heartbeat lets the watermark pass all plays, as the next day's feed would.
    """
    write_parts(plays, folder, files, part)
    last = plays.agg((F.max("fed_at") + F.lit(dt.timedelta(days=1))).alias("fed_at"))
    beat = plays.sparkSession.createDataFrame([], plays.drop(part).schema).unionByName(
        last.withColumns({"event_type": F.lit(HEARTBEAT), "game_id": F.lit(-1).cast("long")}), allowMissingColumns=True
    )
    beat.coalesce(1).write.parquet(f"{folder}/{part}-{files}")


def read_replay(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 1) -> DataFrame:
    """The replay's files in the order they were written, ``per_trigger`` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/*")
