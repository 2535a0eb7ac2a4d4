"""Merges into stored tables, artefacts of unknown shape and merged sketches on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators import sketches, stored
from tallyline.sources import artefacts, landing

SCHEMA = T.StructType(
    [T.StructField("season", T.LongType()), T.StructField("game_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("score", T.LongType())]
)
KEYS, SETS = ("season", "game_id"), ("status", "score")
OLD = [(1, 10, "final", 3), (1, 11, "upcoming", None), (2, 20, "upcoming", None), (3, 30, "final", 1)]


@pytest.fixture
def path(spark, tmp_path):
    target = str(tmp_path / "table")
    landing.save_table(spark.createDataFrame(OLD, SCHEMA), target, SCHEMA, ("season",))
    return target


def _table(spark, path):
    return sorted(tuple(r) for r in landing.load_table(spark, path, SCHEMA).select(*SCHEMA.names).collect())


def _files(spark, path):
    return {r["season"]: (r["files"], r["digest"]) for r in stored.partition_files(spark, path, SCHEMA, "season").collect()}


def _merge(spark, path, rows, **how):
    how = {"guard": F.col("status") != "final"} | how
    return stored.merge_into(spark, path, SCHEMA, spark.createDataFrame(rows, SCHEMA), KEYS, "season", SETS, **how)


def test_only_changed_partitions_are_rewritten(spark, path):
    before = _files(spark, path)
    done = _merge(spark, path, [(1, 10, "final", 9), (1, 11, "final", 2), (3, 30, "final", 8), (4, 40, "upcoming", None)])
    assert done == stored.Merged(inserted=1, updated=1, partitions=2, rejected=0)
    assert _table(spark, path) == [(1, 10, "final", 3), (1, 11, "final", 2), (2, 20, "upcoming", None), (3, 30, "final", 1), (4, 40, "upcoming", None)]
    after = _files(spark, path)
    assert after[2] == before[2] and after[3] == before[3] and after[1] != before[1]


def test_the_same_delivery_again_rewrites_nothing(spark, path):
    rows = [(1, 11, "final", 2), (2, 21, "upcoming", None)]
    assert _merge(spark, path, rows).changed == 2
    before = _files(spark, path)
    again = _merge(spark, path, rows)
    assert (again.changed, again.partitions) == (0, 0) and _files(spark, path) == before


def test_null_keys_repeats_and_extra_columns(spark, path):
    new = spark.createDataFrame(
        [(None, 1, "final", 1, "x"), (2, None, "final", 1, "x"), (2, 20, "final", 1, "x"), (2, 20, "final", 5, "x"), (2, 20, "final", 4, None)],
        "season long, game_id long, status string, score long, _new string",
    )
    done = stored.merge_into(spark, path, SCHEMA, new, KEYS, "season", SETS, guard=F.col("status") != "final", order=("score",))
    assert done == stored.Merged(inserted=0, updated=1, partitions=1, rejected=2)
    assert (2, 20, "final", 5) in _table(spark, path) and len(_table(spark, path)) == len(OLD)


def test_without_inserts_without_guard_and_empty_inputs(spark, path, tmp_path):
    assert _merge(spark, path, [(9, 1, "final", 1)], insert=False).changed == 0
    assert _merge(spark, path, []) == stored.Merged(0, 0, 0, 0)
    assert _table(spark, path) == sorted(OLD, key=str)
    assert _merge(spark, path, [(3, 30, "final", None)], guard=None).updated == 1  # a value may become null
    fresh = str(tmp_path / "absent")
    assert _merge(spark, fresh, OLD).inserted == len(OLD) and _table(spark, fresh) == sorted(OLD, key=str)


def test_large_partitions_get_several_files_and_many_partitions_take_the_join(spark, path, monkeypatch):
    monkeypatch.setattr(stored, "LISTED_PARTITIONS", 1)
    rows = [(5, i, "upcoming", i) for i in range(400)] + [(2, 20, "final", 7)]
    done = _merge(spark, path, rows, rows_per_file=50)
    assert (done.inserted, done.updated, done.partitions) == (400, 1, 2)
    assert _files(spark, path)[5][0] > 1 and len(_table(spark, path)) == len(OLD) + 400


def test_the_partition_is_part_of_the_key(spark, path):
    with pytest.raises(ValueError):
        stored.merge_into(spark, path, SCHEMA, spark.createDataFrame([], SCHEMA), ("game_id",), "season", SETS)


# ---- artefacts -----------------------------------------------------------------------------------------------------


def _docs(spark, *texts):
    return spark.createDataFrame([(i, 100 + i, t) for i, t in enumerate(texts)], "game_id long, season long, text string")


def test_shift_fields_are_those_of_all_documents(spark):
    docs = _docs(
        spark, json.dumps({"data": [{"id": 1, "a": 2}, {"id": 2, "odd name": "x", "game_id": -5}]}), json.dumps({"data": [{"id": 3, "a": 2.5, "deep": {"k": [1]}}]}),
        json.dumps({"data": []}), "no json", None, json.dumps({"other": 1}),
    )
    made = artefacts.shift_table(docs)
    assert set(made.columns) == {"id", "a", "odd name", "deep", "game_id", "season"}
    rows = {r["id"]: r for r in made.collect()}
    assert (rows[1]["a"], rows[2]["a"], rows[3]["a"]) == (2, None, 2.5)
    assert rows[2]["odd name"] == "x" and rows[2]["game_id"] == 0 and rows[3]["deep"]["k"] == [1] and rows[3]["season"] == 101


def test_shifts_of_mixed_types_stay_variants(spark):
    made = artefacts.shift_table(_docs(spark, json.dumps({"data": [{"v": 1}, {"v": "one"}, {"v": None}]})))
    assert sorted(r[0] for r in made.select(F.coalesce(F.to_json("v"), F.lit("null"))).collect()) == ['"one"', "1", "null"]


def test_no_shifts_at_all(spark):
    for docs in (_docs(spark, '{"data": []}', None), _docs(spark, "{}").limit(0)):
        made = artefacts.shift_table(docs)
        assert made.columns == ["game_id", "season"] and made.count() == 0


def test_series_rows_and_information(spark):
    game = {"id": 7, "gameDate": "2024-01-01", "gameState": "OFF", "awayTeam": {"abbrev": "A", "score": 1}}
    made = artefacts.series_table(_docs(spark, json.dumps({"seasonSeries": [game], "gameInfo": {"x": [1, "y"]}}), json.dumps({"seasonSeries": []}), "bad", None))
    rows = sorted((r.asDict() for r in made.collect()), key=lambda r: r["matchup_game_id"] or 0)
    assert len(rows) == 2
    assert rows[0]["game_info"] == '{"x":[1,"y"]}' and rows[0]["game_id"] == 0
    assert (rows[1]["away_team"], rows[1]["away_score"], rows[1]["home_team"], rows[1]["game_info"]) == ("A", 1, None, None)


# ---- sketches ------------------------------------------------------------------------------------------------------


def test_merged_sketches_keep_their_error(spark):
    # keys come on several days, so distinct counts of days do not add up
    rows = spark.range(60_000).select(
        (F.col("id") % 30).alias("day"), (F.xxhash64("id") % 20_011).alias("game_id"), F.pmod(F.xxhash64(F.col("id") + 1), F.lit(5_000)).alias("n"), F.lit("all").alias("span")
    )
    daily = sketches.daily_sketches(rows, "day", "game_id", "n").withColumn("span", F.lit("all"))
    assert daily.count() == 30
    exact = rows.groupBy("span").agg(F.count_distinct("game_id").alias("games"), F.sum("n").alias("events"), F.count(F.lit(1)).alias("game_days"))
    row = sketches.within_error(sketches.merged(daily, "span"), exact, rows, "span").first()
    assert row["distinct_ok"] and row["median_ok"] and row["upper_ok"] and row["games"] > 20_000


def test_flags_can_fail(spark):
    rows = spark.range(1_000).select(F.col("id").alias("n"), F.lit("s").alias("span"))
    wrong = spark.createDataFrame([("s", 700, 600, 500)], "span string, distinct_estimate long, median_estimate long, upper_estimate long")
    exact = spark.createDataFrame([("s", 1_000, 0, 1_000)], "span string, games long, events long, game_days long")
    row = sketches.within_error(wrong, exact, rows, "span").first()
    assert not (row["distinct_ok"] or row["median_ok"] or row["upper_ok"])


def test_shift_documents_are_made_and_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    docs = [json.dumps({"data": [{"id": 10 * i + j, "start": 25.0 if i else 2} for j in range(3)]}) for i in range(4)]
    made = artefacts.shift_table(_docs(spark, *docs).withColumn("text", counted.asNondeterministic()("text")))
    assert dict(made.dtypes)["start"] == "bigint"
    assert sorted((r["id"], r["start"]) for r in made.collect()) == [(10 * i + j, 25 if i else 2) for i in range(4) for j in range(3)]
    assert seen.value == len(docs)
