"""Write PLANS.md: a summary of each dashboard query's physical plan over a written events table.

``python scripts/plan_report.py [sf_dir]`` (default /root/testdata/sf0.01).
"""

import contextlib
import io
import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark import (bulk_order_items, change_alerts, channel_performance, demographic_performance,  # noqa: E402
                      device_performance, geo_performance, kpi_summary, product_performance, product_post,
                      read_events, trend, write_events)
from tidemark.session import ensure_checkpoint_dir, local_session  # noqa: E402
from tidemark.sources.fixtures import build_events  # noqa: E402
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV, THRESHOLDS  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
spark = local_session(cores="4")
path = f"{ensure_checkpoint_dir(spark)}/plans-{uuid.uuid4().hex[:8]}"
write_events(build_events(spark, sf_dir), path)
ev = read_events(spark, path)

QUERIES = {
    "kpi_summary (all)": lambda: kpi_summary(ev, CUR, PREV, "all", BULK_MIN, PATTERNS),
    "kpi_summary (store)": lambda: kpi_summary(ev, CUR, PREV, "store", BULK_MIN, PATTERNS),
    "kpi_summary (online)": lambda: kpi_summary(ev, CUR, PREV, "online", BULK_MIN, PATTERNS),
    "trend (daily)": lambda: trend(ev, CUR, "daily"),
    "product_performance": lambda: product_performance(ev, CUR, PREV),
    "channel_performance": lambda: channel_performance(ev, CUR, PREV),
    "geo_performance": lambda: geo_performance(ev, CUR, PREV),
    "geo_performance (outer_join)": lambda: geo_performance(ev, CUR, PREV, strategy="outer_join"),
    "device_performance": lambda: device_performance(ev, CUR, PREV),
    "demographic_performance": lambda: demographic_performance(ev, CUR, PREV),
    "bulk_order_items": lambda: bulk_order_items(ev, CUR, BULK_MIN),
    "change_alerts": lambda: change_alerts(
        kpi_summary(ev, CUR, PREV, "all", BULK_MIN, PATTERNS), product_post(product_performance(ev, CUR, PREV)),
        channel_performance(ev, CUR, PREV), demographic_performance(ev, CUR, PREV), geo_performance(ev, CUR, PREV),
        THRESHOLDS),
}
NODES = ["HashAggregate", "SortAggregate", "ObjectHashAggregate", "Expand", "SortMergeJoin", "BroadcastHashJoin",
         "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "TakeOrderedAndProject", "Window",
         "Generate", "BatchEvalPython", "ArrowEvalPython"]


def final_plan(df) -> str:
    df.collect()  # AQE: the formatted plan after execution is the final adaptive plan
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


out = ["# Physical plans (final adaptive plans)", "",
       f"Generated by `scripts/plan_report.py` over the events of `{sf_dir}` written with `write_events`.",
       "Counts are operator nodes in the final AQE plan (reused exchanges listed separately).", ""]
for name, build in QUERIES.items():
    p = final_plan(build())
    tree = p.split("\n\n")[0].split("== Initial Plan ==")[0]
    counts = {n: len(re.findall(rf"\b{n} \(", tree)) for n in NODES}
    out.append(f"## {name}")
    out.append("")
    shuffles = len(re.findall(r"(?<![A-Za-z])Exchange \(", tree))
    broadcasts = len(re.findall(r"BroadcastExchange \(", tree))
    out.append(f"* shuffle exchanges: {shuffles}, broadcast exchanges: {broadcasts}, "
               f"reused exchanges: {len(re.findall(r'ReusedExchange \(', tree))}")
    out.append("* operators: " + ", ".join(f"{k} {v}" for k, v in counts.items() if v) or "none")
    # Only nodes of the final plan: its tree names them by number, their details follow below.
    own = set(re.findall(r"Scan parquet[^(\n]*\((\d+)\)", tree))
    details = [d for d in re.split(r"\n\n(?=\(\d+\) )", p) if (m := re.match(r"\((\d+)\) Scan parquet", d)) and m[1] in own]
    scans = [line.strip() for d in details for line in d.splitlines()
             if line.strip().startswith(("ReadSchema", "PartitionFilters", "PushedFilters"))]
    out.append(f"* scans of the events table: {len(details)}")
    out.append("* scans:")
    out += [f"  * `{re.sub(r'#[0-9]+', '', s)}`" for s in scans]
    out.append("")
with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
    f.write("\n".join(out) + "\n")
print("wrote PLANS.md")
