"""Time the headline queries at one scale and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Building
the staged contest facts, stored states and feature table is timed as queries of its own.
"""

from __future__ import annotations

import json
import os
import time

from formbook.catalog import load
from formbook.catalog.serving import stored_states
from formbook.plans import contest
from formbook.session import build_session

HEADLINES = (
    "f2_entity_form", "f4_group_form", "f5_venue_history", "f8_peer_form", "f13_shrunk_delta",
    "f18_deterministic_rank", "f21_priority_dedup", "feature_build", "d1_dimension_joins",
    "d3_lagged_standings", "d9_roster_as_of", "d13_interval_totals", "b4_duplicate_keys",
    "b10_rule_suite", "b13_orphans", "e4_venue_stats", "e7_venue_risk", "e8_entity_stats",
    "e22_wins_pivot", "e32_radar_scores", "e37_rising_and_fading", "i2_all_strategies",
    "j3_exact_medians", "j14_batch_scoring", "j15_per_event_table", "j22_metric_row",
    "j23_metrics_by_season", "j34_running_evaluation", "j36_what_if_each",
    "j37_materialised_next_event", "j39_backtest", "j39_model_backtest", "j3_imputed_and_flagged", "j5_logistic_regression",
    "j26_permutation_importance", "k1_incremental_ingest", "master_build",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small job so that the first query does not pay for starting the JVM.
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, _ = load()
    times: dict[str, float] = {}

    def timed(name, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    timed("stage_contest", lambda: contest.facts(spark, folder))
    timed("stage_states", lambda: stored_states(spark, folder))
    for name in HEADLINES:
        timed(name, lambda name=name: run(queries[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
