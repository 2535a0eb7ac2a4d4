"""Every registered query against its SQL on whole tables of the smallest folder."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tallyline.plans.catalog import registered
from tests.compare import compare

CHECKED = sorted(n for n, (_, sql) in registered().items() if sql is not None)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, sf, name):
    run, sql = registered()[name]
    assert compare(run(spark, sf).toPandas(), duck.execute(sql).df()) is None


def test_entry_points():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 100


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


# names whose operators cut keys into blocks; a small setting makes many blocks of small data
BLOCKED = (
    "play_counters", "active_penalties", "decay_form", "series_state", "season_game_index", "auc", "longest_streak",
    "strategy_backtest", "member_leaderboard", "state_from_documents",
)


@pytest.mark.parametrize("name", BLOCKED)
def test_hot_keys_give_the_same_result(spark, duck, sf, name):
    run, sql = registered()[name]
    spark.conf.set("spark.tallyline.blockRows", "16")
    try:
        got = run(spark, sf).toPandas()
    finally:
        spark.conf.unset("spark.tallyline.blockRows")
    assert compare(got, duck.execute(sql).df()) is None


@pytest.mark.parametrize("missing", ["tallyline.llm.queries", "corpus_pipeline"])
def test_entry_lists_the_rest_without_the_optional_parts(monkeypatch, missing):
    import sys

    whole = set(entry.queries())
    monkeypatch.setitem(sys.modules, missing, None)
    left = set(entry.queries())
    assert set(registered()) <= left <= whole and "pipeline" not in left
    assert set(entry.oracle_sql()) <= left
