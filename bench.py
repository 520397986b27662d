"""Benchmark: the dashboard's queries over the nested events table.

Env: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Step 1 derives the nested events table from the driver's tables and writes
it once as Parquet partitioned by ``event_date`` under the session's
checkpoint folder (timed as ``load_events``); every query then reads that
table, as a deployment reads its event export.  Each query runs twice on
freshly built DataFrames: ``queries``/``value`` are the second (steady-state)
pass, ``cold_queries``/``cold_total`` the first.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import (  # noqa: E402
    Dashboard, bulk_order_items, channel_performance, dashboard, demographic_performance, device_performance,
    geo_performance, kpi_summary, product_performance, product_post, read_events, trend, trend_conversion,
    write_events)
from tidemark.session import ensure_checkpoint_dir, local_session  # noqa: E402
from tidemark.sources.fixtures import build_events  # noqa: E402
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV, THRESHOLDS  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="tidemark-bench")
    out_dir = os.path.join(ensure_checkpoint_dir(spark), f"bench-events-{uuid.uuid4().hex[:8]}")

    timings: dict[str, float] = {}

    def timed(name: str, fn) -> None:
        t = time.perf_counter()
        fn()
        timings[name] = round(time.perf_counter() - t, 3)

    timed("load_events", lambda: write_events(build_events(spark, sf_dir), out_dir, partitions=int(cpus)))
    ev = read_events(spark, out_dir)

    def run(result) -> None:
        for df in (result.frames().values() if isinstance(result, Dashboard) else [result]):
            df.collect()

    summary = lambda: kpi_summary(ev, CUR, PREV, "all", BULK_MIN, PATTERNS)
    plan = {
        "kpi_summary_all": summary,
        "kpi_summary_store": lambda: kpi_summary(ev, CUR, PREV, "store", BULK_MIN, PATTERNS),
        "kpi_summary_online": lambda: kpi_summary(ev, CUR, PREV, "online", BULK_MIN, PATTERNS),
        "trend_daily": lambda: trend_conversion(trend(ev, CUR, "daily")),
        "trend_weekly_online": lambda: trend(ev, CUR, "weekly", "online"),
        "product_performance": lambda: product_post(product_performance(ev, CUR, PREV)),
        "channel_performance": lambda: channel_performance(ev, CUR, PREV),
        "geo_performance": lambda: geo_performance(ev, CUR, PREV),
        "device_performance": lambda: device_performance(ev, CUR, PREV),
        "demographic_performance": lambda: demographic_performance(ev, CUR, PREV),
        "bulk_order_items": lambda: bulk_order_items(ev, CUR, BULK_MIN),
        # One full render: every result once (materialised), derived KPIs and alerts from those.
        "dashboard_render": lambda: dashboard(ev, CUR, PREV, "online", "daily", BULK_MIN, PATTERNS, THRESHOLDS),
    }
    # Pass 1 (cold: JIT, code generation, file listing) and pass 2 (steady state).
    # Every run builds its DataFrames afresh, so pass 2 recomputes everything.
    cold: dict[str, float] = {}
    for name, build in plan.items():
        t = time.perf_counter()
        run(build())
        cold[name] = round(time.perf_counter() - t, 3)
    for name, build in plan.items():
        timed(name, lambda b=build: run(b()))

    m = re.search(r"sf([0-9.]+)", sf_dir)
    query_total = round(sum(v for k, v in timings.items() if k != "load_events"), 3)
    print(json.dumps({"metric": "dashboard_queries_total", "value": query_total, "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else None, "cpus": int(cpus),
                      "cold_total": round(sum(cold.values()), 3), "cold_queries": cold}))
    spark.stop()


if __name__ == "__main__":
    main()
