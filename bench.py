"""Headline queries, timed: prints one JSON line. Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyline.plans.catalog import registered  # noqa: E402
from tallyline.session import build_session, remove_finished  # noqa: E402

HEADLINE = (
    "flag_rolling_form", "rest_and_congestion", "season_splits", "head_to_head", "series_state", "merged_features",
    "elo_ratings", "decay_form", "season_game_index", "accuracy_brier_logloss", "auc", "reliability_curve", "psi_drift",
    "monitoring_summary", "season_scorecard", "model_leaderboard", "adaptive_home_grid", "play_counters", "running_score",
    "active_penalties", "latest_state_per_game", "event_timeline", "settle_picks", "member_leaderboard", "strategy_backtest",
    "upsert_upcoming", "flatten_schedule", "flatten_plays", "comment_threads", "dq_report", "upcoming_features", "platt_scaling",
    "stream_ratings", "walk_forward_logistic", "stream_game_state", "refresh_payload", "merge_stored_results", "flatten_shifts", "sketch_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    shared = os.environ.get("BENCH_SHARED_DIR", os.path.join(os.path.dirname(os.path.abspath(__file__)), "spark-warehouse", "shared"))
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, {"spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    run = registered()
    # start-up of the JVM is not part of a query: one untimed run of the flagship
    run[HEADLINE[0]][0](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        remove_finished(spark)
    line = {
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""), "cpus": cpus,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
