"""Scale and skew probe: replicate the sf0.1 events R times and time the dashboard queries.

``python scripts/scale_probe.py R [skew]`` — every copy gets its own users and
transactions; with ``skew`` one third of the copies are folded into a single
user, session and transaction (a hot key holding a third of all rows).  Prints
per-query wall time and, from Spark's event log (written to a fresh scratch
folder), the slowest task against the median task of each query's stages.
"""

import glob
import io
import json
import os
import statistics
import sys
import tempfile
import time
import uuid

import zstandard

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidemark import (channel_performance, demographic_performance, kpi_summary, product_performance,  # noqa: E402
                      read_events, trend, write_events)
from tidemark.session import ensure_checkpoint_dir, local_session  # noqa: E402
from tidemark.sources.fixtures import build_events  # noqa: E402
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV  # noqa: E402

R = int(sys.argv[1]) if len(sys.argv) > 1 else 10
SKEW = len(sys.argv) > 2 and sys.argv[2] == "skew"
log_dir = tempfile.mkdtemp(prefix="run-eventlog-")
spark = local_session(extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
base = ensure_checkpoint_dir(spark)
tag = uuid.uuid4().hex[:8]

src_path = f"{base}/scale-src-{tag}"
write_events(build_events(spark, "/root/testdata/sf0.1"), src_path)
src = read_events(spark, src_path)

rep = src.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(R - 1))))
hot = (F.col("_r") < F.lit(R // 3)) if SKEW else F.lit(False)
sid_entry = lambda p: F.struct(p["key"].alias("key"), F.struct(
    p["value"]["string_value"].alias("string_value"),
    F.when(hot & (p["key"] == "ga_session_id"), F.lit(1).cast("bigint")).otherwise(p["value"]["int_value"])
    .alias("int_value")).alias("value"))
scaled = rep.select(
    "event_timestamp",
    F.when(hot, F.lit("hot")).otherwise(F.concat("user_pseudo_id", F.lit("_"), F.col("_r").cast("string")))
    .alias("user_pseudo_id"),
    "event_name",
    F.struct(F.when(hot & F.col("ecommerce.transaction_id").isNotNull(), F.lit("T_hot"))
             .otherwise(F.concat("ecommerce.transaction_id", F.lit("_"), F.col("_r").cast("string")))
             .alias("transaction_id"),
             F.col("ecommerce.purchase_revenue").alias("purchase_revenue")).alias("ecommerce"),
    F.transform("event_params", sid_entry).alias("event_params"),
    "user_properties", "items", "traffic_source", "geo", "device", "event_date")
path = f"{base}/scale-x{R}{'-skew' if SKEW else ''}-{tag}"
t = time.perf_counter()
write_events(scaled, path, partitions=32)
print(f"wrote {R}x copies in {time.perf_counter() - t:.1f}s", flush=True)
ev = read_events(spark, path)
n = ev.count()

queries = {
    "kpi_summary_all": lambda: kpi_summary(ev, CUR, PREV, "all", BULK_MIN, PATTERNS),
    "kpi_summary_store": lambda: kpi_summary(ev, CUR, PREV, "store", BULK_MIN, PATTERNS),
    "trend_daily": lambda: trend(ev, CUR, "daily"),
    "product_performance": lambda: product_performance(ev, CUR, PREV),
    "channel_performance": lambda: channel_performance(ev, CUR, PREV),
    "demographic_performance": lambda: demographic_performance(ev, CUR, PREV),
}
wall = {}
for name, q in queries.items():
    spark.sparkContext.setJobGroup(name, name)
    t = time.perf_counter()
    q().collect()
    wall[name] = round(time.perf_counter() - t, 2)
    print(name, wall[name], flush=True)
spark.stop()

# Per query: slowest task vs median task over its stages.
tasks: dict[str, list[int]] = {}
stage_group: dict[int, str] = {}
for f in glob.glob(f"{log_dir}/*/*"):
    raw = open(f, "rb").read()
    if f.endswith(".zstd"):
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    for line in raw.decode().splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageSubmitted":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            if g:
                stage_group[e["Stage Info"]["Stage ID"]] = g
        elif e["Event"] == "SparkListenerTaskEnd":
            g = stage_group.get(e["Stage ID"])
            if g:
                ti = e["Task Info"]
                tasks.setdefault(g, []).append(ti["Finish Time"] - ti["Launch Time"])
skew = {g: {"tasks": len(v), "median_ms": statistics.median(v), "max_ms": max(v)} for g, v in tasks.items()}
print(json.dumps({"copies": R, "skew": SKEW, "events": n, "wall_sec": wall, "tasks": skew}))
