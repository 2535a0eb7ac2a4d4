"""Scores, calibration, drift and the study on samples with known answers."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions import calendar, contest
from tallyline.functions.numbers import signed, tidy
from tallyline.operators import board, models, quality, scores, store
from tallyline.plans.scan import BLOCK_ROWS


def pairs(spark, rows):
    return spark.createDataFrame(rows, "p double, y long")


def probs(spark, values):
    return spark.createDataFrame([(v,) for v in values], "p double")


def test_scores_of_three_games(spark):
    row = scores.score(pairs(spark, [(0.8, 1), (0.3, 0), (0.6, 0)]), "p", "y").first()
    losses = [-math.log(x) for x in (0.8, 0.7, 0.4)]
    got = (row["accuracy"], row["brier"], row["log_loss"], row["baseline_log_loss"])
    assert got == (pytest.approx(66.7), pytest.approx(0.49 / 3, abs=1e-4), pytest.approx(sum(losses) / 3, abs=1e-4), pytest.approx(math.log(2), abs=1e-4))


def test_auc(spark):
    long = spark.createDataFrame([("m", 0.1, 0), ("m", 0.4, 0), ("m", 0.4, 1), ("m", 0.9, 1), ("one", 0.3, 1)], "model string, p double, y long")
    got = {r["model"]: r["auc"] for r in scores.auc(long).collect()}
    assert got == {"m": 0.875, "one": None}


def test_reliability_bands(spark):
    """Both sides of one half fold together: .08 without a win is as good as .92 with one."""
    rows = [(0.08, 0), (0.92, 1), (0.93, 0), (0.61, 1)]
    bands = {r["range"]: r for r in scores.reliability_curve(pairs(spark, rows)).collect()}
    assert len(bands) == 10
    assert {k: r["games"] for k, r in bands.items() if r["games"]} == {"90-95%": 3, "60-65%": 1}
    assert bands["50-55%"]["predicted"] is None


@pytest.mark.parametrize(("p", "wins", "losses", "low", "high"), [(0.62, 62, 38, 0.0, 0.6), (0.82, 41, 41, 31.0, 33.0), (0.18, 9, 41, 0.0, 0.6)])
def test_calibration_error(spark, p, wins, losses, low, high):
    curve = scores.reliability_curve(pairs(spark, [(p, 1)] * wins + [(p, 0)] * losses))
    assert low <= scores.calibration_error(curve).first()["ece"] <= high


def summary(spark, wins, games, p=0.64):
    return scores.summarise(pairs(spark, [(p, int(i < wins)) for i in range(games)]))


@pytest.mark.parametrize(
    ("wins", "games", "status"), [(128, 200, "on-track"), (190, 200, "above-baseline"), (50, 200, "below-baseline"), (7, 9, "warming-up")]
)
def test_live_sample_beside_the_reference(spark, wins, games, status):
    live = summary(spark, wins, games)
    assert scores.compare(live, summary(spark, 64, 100)).first()["status"] == status
    assert live.first()["enough"] is (games >= scores.MIN_SAMPLE)


@pytest.mark.parametrize(("current", "known", "provisional"), [(12, False, True), (60, True, True), (150, True, False)])
def test_drift_needs_enough_games(spark, current, known, provisional):
    row = scores.drift_report(probs(spark, [0.35, 0.65] * 120), probs(spark, [0.8] * current)).first()
    assert ((row["psi"] is not None), row["provisional"]) == (known, provisional)
    assert row["verdict"] == ("shifted" if known else "unknown")


def test_psi_of_equal_far_and_missing_samples(spark):
    index = lambda a, b: scores.psi(probs(spark, a), probs(spark, b)).first()["psi"]
    mixed = [i / 40 for i in range(1, 40)]
    assert index(mixed, mixed[::-1]) == 0.0
    assert index([0.22] * 80, [0.78] * 80) > scores.PSI_MODERATE
    assert index(mixed, []) is None and index([], mixed) is None


def test_drift_words(spark):
    words = spark.createDataFrame([(None,), (0.02,), (0.19,), (1.3,)], "v double").select(scores.drift_verdict(F.col("v")))
    assert [r[0] for r in words.collect()] == ["unknown", "stable", "watch", "shifted"]


def test_phase_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(0.6, 1, x) for x in (0.0, 0.2, 0.200001, 1.0, 1.7)], "p double, y long, game_progress double")
    got = {r["phase"]: r["n"] for r in scores.phase_buckets(df).collect()}
    assert got == {"(0.0, 0.2]": 1, "(0.2, 0.4]": 1, "(0.95, 1.0]": 2}


def test_home_rate_never_sees_its_own_row(spark):
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i // 3), 0.5, (i * 7) % 3 % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "game_id long, game_date date, p double, y long")
    spark.conf.set("spark.tallyline.blockRows", "8")
    try:
        got = {r["game_id"]: r["home_rate_5"] for r in scores.rolling_home_rate(df, (5,)).collect()}
    finally:
        spark.conf.unset("spark.tallyline.blockRows")
    row = spark.range(1).select(scores.adapted(F.lit(0.7), F.lit(None).cast("double"), 1.0)).first()
    assert row[0] == pytest.approx(0.7)  # unchanged while no rate is known
    ys = [r[3] for r in rows]
    assert len(got) == 40
    assert all(got[i] == (None if i < 5 else sum(ys[i - 5:i]) / 5) for i in range(40))


def test_odds_and_texts(spark):
    df = spark.createDataFrame([(0.5,), (0.75,), (0.25,), (0.9,), (0.0,), (1.0,)], "p double")
    assert [r[0] for r in df.select(contest.fair_odds(F.col("p"))).collect()] == [-100, -300, 300, -900, 4900, -4900]
    row = spark.range(1).select(signed(F.lit(150)), signed(F.lit(-180)), tidy(F.lit(24.0)), tidy(F.lit(3.3)), tidy(F.lit(None).cast("double"))).first()
    assert list(row) == ["+150", "-180", "24", "3.3", "-"]


def test_seasons_and_clocks(spark):
    days = [("2026-10-15", 20262027), ("2027-03-01", 20262027), ("2026-06-14", 20252026), ("2026-08-01", 20262027)]
    df = spark.createDataFrame([(d,) for d, _ in days], "d string")
    assert [r[0] for r in df.select(calendar.season_of(calendar.iso_date(F.col("d")))).collect()] == [s for _, s in days]
    clocks = spark.createDataFrame([("12:34",), ("5",), ("aa:10",), (None,), ("",)], "c string")
    assert [r[0] for r in clocks.select(calendar.clock_seconds(F.col("c"))).collect()] == [754, None, None, None, None]
    zero = spark.range(1).select(
        calendar.game_seconds(F.lit(0), F.lit("01:00")), calendar.game_seconds(F.lit(0), F.lit("01:00"), live=True), calendar.game_seconds(F.lit(5), F.lit("00:30"))
    ).first()
    assert list(zero) == [-1140, 0, 3930]


def test_situation_codes(spark):
    df = spark.createDataFrame([("1541",), ("651",), ("15x1",), (None,), ("1551",)], "c string")
    got = [tuple(r) for r in df.select(*contest.situation(F.col("c")).values()).collect()]
    assert got == [(4, 5, 1, 1), (5, 6, 1, 0), (5, 5, 1, 1), (5, 5, 1, 1), (5, 5, 1, 1)]


@pytest.mark.parametrize(("newest_first", "streak"), [([1, 1, 1, 0, 1, 1], 3), ([0, 1, 1, 1], 0), ([1, 1, 1], 3)])
def test_current_streak(spark, newest_first, streak):
    rows = [(1, len(newest_first) - i, v) for i, v in enumerate(newest_first)]
    df = spark.createDataFrame(rows, "user_id long, game_id long, is_correct long")
    assert board.current_streaks(df).first()["streak"] == streak


def test_settling_pays_once(spark):
    picks = spark.createDataFrame([(1, 1, "home", None, None), (2, 1, "away", None, None), (3, 2, "home", None, None), (4, 1, "home", 0, 7)], "user_id long, game_id long, pick string, is_correct long, points long")
    results = spark.createDataFrame([(1, "home"), (2, None)], "game_id long, winner string")
    once = board.settle(picks, results)
    got = {r["user_id"]: (r["is_correct"], r["points"]) for r in once.collect()}
    assert got == {1: (1, 100), 2: (0, 10), 3: (None, None), 4: (0, 7)}
    assert sorted(once.collect()) == sorted(board.settle(once, results).collect())


def test_guarded_upsert_and_results(spark):
    old = spark.createDataFrame([(1, "final", 0.6), (2, "upcoming", 0.5)], "game_id long, status string, prob double")
    new = spark.createDataFrame([(1, "upcoming", 0.9), (2, "upcoming", 0.8), (3, "upcoming", 0.7)], "game_id long, status string, prob double")
    got = store.upsert(old, new, ["game_id"], keep=("status",), guard=F.col("status") == "upcoming")
    assert {tuple(r) for r in got.collect()} == {(1, "final", 0.6), (2, "upcoming", 0.8), (3, "upcoming", 0.7)}
    twice = spark.createDataFrame([(3, "b", 0.2), (3, "a", 0.9), (1, "z", 0.1)], new.schema)
    assert [tuple(r) for r in store.insert_absent(old, twice, ["game_id"], ["prob"]).filter("game_id = 3").collect()] == [(3, "b", 0.2)]
    assert [tuple(r) for r in store.upsert(old, twice, ["game_id"], order=["prob"]).filter("game_id = 3").collect()] == [(3, "a", 0.9)]
    sets = {"prob": F.col("_n_prob")}
    assert store.update_where(old, twice, ["game_id"], F.lit(True), sets).count() == old.count()
    assert {tuple(r) for r in store.insert_absent(old, new, ["game_id"]).collect()} == {(1, "final", 0.6), (2, "upcoming", 0.5), (3, "upcoming", 0.7)}


def test_quality_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "game_id long")
    assert quality.duplicate_ids(df, "game_id").first()[0] == 1
    assert quality.missing_columns(df, ["game_id", "venue"]) == ["venue"]
    with pytest.raises(ValueError):
        quality.require_columns(df, ["venue"])
    late = spark.createDataFrame([(dt.date(2025, 1, 2), dt.date(2025, 1, 1)), (dt.date(2025, 1, 2), dt.date(2025, 1, 2))], "game_date date, source_date date")
    assert quality.leakage(late).first()["leaks"] == 1


def test_fitted_weights_equal_newton(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, (800, 2))
    x = np.log(p / (1 - p))
    y = (rng.uniform(size=800) < 1 / (1 + np.exp(-(x @ [0.7, 0.2] + 0.1)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(p, y, strict=True)], "a double, b double, y long")
    weights, bias = models.fit_logits(df, ["a", "b"])
    design = np.column_stack([x, np.ones(800)])
    beta = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-design @ beta))
        beta -= np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]), design.T @ (q - y))
    assert [*weights, bias] == pytest.approx(list(beta), abs=1e-4)
    assert not math.isnan(bias)


def test_longest_runs_deal_the_games_once_for_all_models(spark):
    rng = random.Random(3)
    rows = [(i, dt.date(2024, 1, 1 + rng.randrange(9)), rng.random() ** 0.2, None if i % 50 == 7 else rng.random(), rng.randrange(2)) for i in rng.sample(range(4000), 900)]
    rows = [(*r[:4], int(r[2] >= 0.5) if rng.random() < 0.9 else r[4]) for r in rows]
    df = spark.createDataFrame([*rows, (None, dt.date(2024, 1, 1), 0.1, 0.1, 1)], "game_id long, game_date date, a double, b double, y long")
    spark.conf.set(BLOCK_ROWS[0], "64")
    try:
        made = scores.longest_runs(df, ["a", "b"])
        got = {r["model"]: r["best_streak"] for r in made.collect()}
        plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.unset(BLOCK_ROWS[0])
    for model, at in (("a", 2), ("b", 3)):
        best = run = 0
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            run = run + 1 if r[at] is not None and (r[at] >= 0.5) == (r[4] == 1) else 0
            best = max(best, run)
        assert got[model] == best
    # the models come apart last, from one row
    assert "Generate" in plan[0] and not any("Generate" in line for line in plan[1:])
    assert scores.longest_runs(df.limit(0), ["a", "b"]).count() == 0
