"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query
is run BENCH_RUNS times (default 2) to a sink that discards rows; its figure is the best run.
``panel_build`` is the derivation of the fact table, ``stored_views_build`` that of the
best view, brand frame and event table, ``stored_edges_build`` the mining of the graph's edges: the other
queries read them as stored tables (c11 mines for itself).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.plans import REGISTRY, tables  # noqa: E402
from panelspark.plans.correlation_queries import stored_edges  # noqa: E402
from panelspark.session import local_session  # noqa: E402

HEADLINE = ["v1_current_vintage", "v2_best_source", "v4_provenance", "v5_source_disagreements", "p1_series", "t1_yoy",
            "t5_trends", "a1_latest", "a10_headline", "a11_movers", "r1_revisions", "r3_revisions_summary",
            "e4_event_study", "e4_point_event_study", "c5_pooled_lags", "c8_granger", "c11_mine_edges", "g2_beta_stats",
            "n4_degree_centrality", "n9_propagate", "f2_drift", "f8_forecast", "i1_validate", "i5_dedup_records",
            "i8_ingestion_summary", "d6_rollup", "s5_flatten_jsonstat", "s9_release_facts"]


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    discard(spark.range(1_000_000).selectExpr("id % 100 as k", "id").groupBy("k").count())   # starts the executor
    times: dict[str, float] = {}
    start = time.perf_counter()
    discard(tables.records(spark, sf_dir))
    times["panel_build"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    for view in (tables.panel(spark, sf_dir).best, tables.brand_frame(spark, sf_dir), tables.events(spark, sf_dir)):
        discard(view)
    times["stored_views_build"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    discard(stored_edges(spark, sf_dir))
    times["stored_edges_build"] = round(time.perf_counter() - start, 3)
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            discard(REGISTRY[name].run(spark, sf_dir))
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
