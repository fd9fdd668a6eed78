"""Wall time of the headline queries. Prints one JSON line.

All headline queries, each after the same warm-up. BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 4), BENCH_RUNS (default 1; the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from matchlens.plans import catalog
from matchlens.session import local_session

HEADLINE = (
    "a1_season_cumulative", "a3_season_leaderboard", "a2_week_leaderboard", "a4_fantasy_season", "a5_adaptive_qualifier",
    "a6_team_stats", "a7_team_defense", "a8_team_records", "w10_running_record", "a11_conference_summary", "a15_double_doubles", "k6_game_highs",
    "j6_rank_as_of", "c7_quality_wins", "c8_upsets_rpi", "w9_newest_earlier_season", "c6_transfer_impact", "a23_pbp_season_stats", "p3_attack_touches",
    "p6_rotations", "p7_set_lineups", "p10_set_aggregates", "p11_scoring_timeline", "p12_match_momentum", "w4_league_percentiles", "c10_scouting_report",
    "u2_scoreboard", "c14_broadcast_ingest", "j15_fuzzy_names", "n3_school_key_documents", "a18_reconcile_summary", "s8_upsert_box_lines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session("bench", cpus, partitions=max(int(cpus) * 2, 4))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.spark_queries()
    runs_each = int(os.environ.get("BENCH_RUNS", "1"))
    seconds: dict[str, float] = {}
    run = lambda name, where=sf_dir: queries[name](spark, where).write.format("noop").mode("overwrite").save()
    # Every query runs on the smallest data beside the measured one first.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = small if os.path.isdir(small) else sf_dir
    for name in HEADLINE:
        run(name, warm)
        times = []
        for _ in range(runs_each):
            began = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
