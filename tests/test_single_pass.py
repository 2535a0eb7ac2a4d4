"""Wide inputs are read, parsed and added up once, however many columns are made of them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyline.operators import history, live
from tallyline.plans import catalog_form, catalog_ratings, catalog_sources
from tallyline.sources import flatten


def _box(spark, rows):
    docs = spark.createDataFrame(rows, "game_id long, season long, game_date string, home_team string, away_team string, box string, rail string")
    parsed = docs.select("*", F.from_json("box", flatten.BOXSCORE).alias("b"), F.from_json("rail", flatten.RAIL).alias("r"))
    return parsed.select("game_id", "season", "game_date", "home_team", "away_team", "b.*", "r.*")


def test_team_rows_add_skaters_and_rail_outside_the_generator(spark):
    skater = {"pim": 2, "hits": 3, "powerPlayGoals": 1, "faceoffWinningPctg": 0.25}
    groups = {"forwards": [skater, {"hits": 4, "faceoffWinningPctg": 0.0}, None], "defense": [{"faceoffWinningPctg": 0.75, "giveaways": 5}]}
    box = {"homeTeam": {"abbrev": "AAA", "score": 3, "sog": 20}, "awayTeam": {"score": 1, "sog": 11}, "playerByGameStats": {"homeTeam": groups}}
    rail = {"teamGameStats": [
        {"category": "hits", "homeValue": "-1", "awayValue": "-1"}, {"category": "hits", "homeValue": "9", "awayValue": None},
        {"category": "powerPlay", "homeValue": "1/4", "awayValue": "none"}, {"category": "sog", "homeValue": "NaN", "awayValue": "12"},
    ]}
    rows = [(1, 1, "d", "HHH", "VVV", json.dumps(box), json.dumps(rail)), (2, 1, "d", "HHH", "VVV", json.dumps(box), None), (3, 1, "d", "HHH", "VVV", None, None)]
    made = flatten.team_rows(_box(spark, rows))
    got = {(r["game_id"], r["is_home"]): r for r in made.collect()}
    home, away = got[1, 1], got[1, 0]
    assert (home["team"], home["opponent"], home["goals_for"], home["goals_against"]) == ("AAA", "VVV", 3, 1)
    assert (home["hits"], home["powerplay_goals"], home["powerplay_opportunities"], home["shots_for"], home["shots_against"]) == (9.0, 1.0, 4, 20.0, 12.0)
    assert (home["penalty_minutes"], home["giveaways"], home["faceoff_win_pct"]) == (2.0, 5.0, 0.5)
    assert (away["hits"], away["powerplay_goals"], away["powerplay_opportunities"], away["shots_for"], away["faceoff_win_pct"]) == (0.0, 0.0, None, 12.0, None)
    assert (got[2, 1]["hits"], got[2, 1]["shots_for"], got[2, 1]["powerplay_opportunities"]) == (7.0, 20.0, None)
    assert (got[3, 1]["team"], got[3, 1]["hits"], got[3, 1]["shots_for"]) == ("HHH", 0.0, None)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    generator = next(line for line in plan.splitlines() if "Generate" in line)
    assert "lambda" not in generator and "struct(" not in generator


def _folders(df):
    return {path.rsplit("/", 2)[-2] for path in df.inputFiles()}


def test_play_documents_are_made_once(spark, sf, monkeypatch):
    seen = []
    made = live.GameEvents.__init__

    def keep(self, plays):
        seen.append(plays)
        made(self, plays)

    monkeypatch.setattr(live.GameEvents, "__init__", keep)
    for query in (catalog_sources.live_state_rows, catalog_sources.state_from_documents):
        assert not any("events.parquet" in path for path in query(spark, sf).inputFiles())
    assert len(seen) == 2 and all(name.startswith("document-plays") for plays in seen for name in _folders(plays))


def test_the_training_table_reads_games_and_line_items_once(spark, sf):
    for query in (catalog_form.merged_features, catalog_ratings.model_dataset):
        read = query(spark, sf).inputFiles()
        assert read and not any(name in path for path in read for name in ("orders.parquet", "customer.parquet", "lineitem.parquet"))


def test_form_passes_the_joins_as_one_value_a_side(spark):
    games = spark.createDataFrame([(1, 10, 2024, "d", 7, 8), (2, 11, 2024, "d", 8, 9), (3, 12, 2024, "d", None, 7)], "game_id long, x long, season long, game_date string, home_team long, away_team long")
    form = spark.createDataFrame([(7, 2024, "d", 0.5, None), (8, 2024, "d", 0.25, "G")], "team long, season long, game_date string, a double, b string")
    made = history.attach(games, form)
    got = sorted(tuple(r) for r in made.select("game_id", "x", "home_a", "home_b", "away_a", "away_b").collect())
    assert got == [(1, 10, 0.5, None, 0.25, "G"), (2, 11, 0.25, "G", None, None), (3, 12, None, None, 0.5, None)]
    joins = [line for line in made._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("SortMergeJoin" in line for line in joins)
    assert "struct(a," in made._jdf.queryExecution().optimizedPlan().toString()
