"""One dashboard render: every result of a period comparison, alerts derived from the others.

A render reads the events in six scans: the daily grain (summary and trend of
any source mode), the figures of all labels (regions, devices, demographics),
channels, products (two) and bulk items.  These are written first; summary,
trend and the label breakdowns are made from the written grain and figures.
The results are tiny (two rows, one row per period bucket, at most k rows), so
each is computed once and written as a small Parquet table in a fresh folder under the cluster's shared checkpoint
folder (``spark.checkpoint.dir``); the derived KPIs and alerts then read those
tables instead of recomputing every breakdown, and a lost executor never
forces a recomputation from the events.  (An eager ``checkpoint()`` of an
uncached frame would compute it twice: once to count, once to write.)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.alerts import AlertThresholds, change_alerts, revenue_share
from tidemark.operators.breakdowns import (
    channel_performance, demographic_of, demographic_performance, device_of, device_performance, geo_of, geo_performance,
    label_breakdowns, product_performance, product_post)
from tidemark.operators.bulk import bulk_order_items
from tidemark.operators.grain import BULK_MIN_REVENUE, daily_grain
from tidemark.operators.kpi import grain_kpi_summary, grain_trend, kpi_derived, kpi_summary, trend, trend_conversion
from tidemark.operators.orders import RepairPatterns
from tidemark.operators.sessions import STORE_SOURCES
from tidemark.plans.periods import Period, covering
from tidemark.session import checkpoint_dir
from tidemark.sources.events import scan


@dataclass
class Dashboard:
    summary: DataFrame
    derived: DataFrame
    trend: DataFrame
    products: DataFrame
    channels: DataFrame
    regions: DataFrame
    devices: DataFrame
    demographics: DataFrame
    bulk_items: DataFrame
    alerts: DataFrame
    folder: str | None = field(default=None, repr=False)
    #: Events read and left out (see ``grain.accounting``), counted by the job that wrote the grain; None for lazy frames.
    accounting: dict[str, int] | None = field(default=None, repr=False)

    def frames(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("folder", "accounting")}

    def close(self) -> None:
        """Delete the render's folder; its frames cannot be read afterwards."""
        if self.folder:
            sc = self.summary.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            self.folder = None


#: Label column of each breakdown.
LABELS = {"products": "product_name", "channels": "channel", "regions": "location", "devices": "device",
          "demographics": "demographic"}


def _shown(frame: DataFrame, name: str, uncut: bool = False) -> DataFrame:
    return revenue_share(frame, LABELS[name], uncut=uncut)


def event_frames(events: DataFrame, cur: Period, prev: Period, bulk_min: float, patterns: RepairPatterns, product_k: int,
                 breakdown_k: int, bulk_k: int, counted: Observation | None = None) -> dict[str, DataFrame]:
    """All that a render reads from the events: six scans, whatever the source mode."""
    return {
        "grain": daily_grain(scan(events, covering(cur, prev)), bulk_min, patterns, counted),
        "labels": label_breakdowns(events, cur, prev),
        "products": _shown(product_post(product_performance(events, cur, prev, product_k)), "products"),
        "channels": _shown(channel_performance(events, cur, prev, breakdown_k, fill_zero=True), "channels"),
        "bulk_items": revenue_share(bulk_order_items(events, cur, bulk_min, bulk_k), "product_name", "item_revenue"),
    }


def derived_frames(daily: DataFrame, labels: DataFrame, cur: Period, prev: Period, source: str, grain: str, bulk_min: float,
                   patterns: RepairPatterns, breakdown_k: int, store_sources: Iterable[str]) -> dict[str, DataFrame]:
    """What a render makes from the written grain and label figures; devices are not cut, so their ranks are counted."""
    return {
        "summary": grain_kpi_summary(daily, cur, prev, source, bulk_min, patterns, store_sources),
        "trend": trend_conversion(grain_trend(daily, cur, grain, source, store_sources)),
        "regions": _shown(geo_of(labels, breakdown_k, fill_zero=True), "regions"),
        "devices": _shown(device_of(labels, fill_zero=True), "devices", uncut=True),
        "demographics": _shown(demographic_of(labels, breakdown_k, fill_zero=True), "demographics"),
    }


def lazy_frames(events: DataFrame, cur: Period, prev: Period, source: str, grain: str, bulk_min: float,
                patterns: RepairPatterns, product_k: int, breakdown_k: int, bulk_k: int,
                store_sources: Iterable[str]) -> dict[str, DataFrame]:
    """The same frames straight from the events, nothing written."""
    from_events = event_frames(events, cur, prev, bulk_min, patterns, product_k, breakdown_k, bulk_k)
    return {n: from_events[n] for n in ("products", "channels", "bulk_items")} | {
        "summary": kpi_summary(events, cur, prev, source, bulk_min, patterns, store_sources),
        "trend": trend_conversion(trend(events, cur, grain, source, store_sources)),
        "regions": _shown(geo_performance(events, cur, prev, breakdown_k, fill_zero=True), "regions"),
        "devices": _shown(device_performance(events, cur, prev, fill_zero=True), "devices", uncut=True),
        "demographics": _shown(demographic_performance(events, cur, prev, breakdown_k, fill_zero=True), "demographics"),
    }


def dashboard(events: DataFrame, cur: Period, prev: Period, source: str = "all", grain: str = "daily",
              bulk_min: float = BULK_MIN_REVENUE, patterns: RepairPatterns = RepairPatterns(),
              thresholds: AlertThresholds = AlertThresholds(), materialize: bool = True,
              parallelism: int = 4, product_k: int = 20, breakdown_k: int = 10, bulk_k: int = 20,
              store_sources: Iterable[str] = STORE_SOURCES) -> Dashboard:
    """All results of one render: ranks and revenue shares on every breakdown, percentages without a base as 0.

    ``source`` applies to the summary and the trend (``store_sources`` are the
    in-store ones); breakdowns and bulk items cover all sources, cut to
    ``product_k``, ``breakdown_k`` and ``bulk_k`` rows (devices are all shown).
    With ``materialize`` (default) the base results are written at once under
    ``spark.checkpoint.dir``, which must be set (this runs their jobs, up to
    ``parallelism`` of them concurrently on the shared session), and everything
    derived reads them until ``close()``; without it every frame stays lazy.
    """
    order = {"summary": (F.col("type"),), "trend": (F.col("period_label"),),
             "bulk_items": (F.col("item_revenue").desc_nulls_last(), F.col("product_name").asc_nulls_first()),
             **{n: (F.col("current_revenue").desc_nulls_last(), F.col(label).asc_nulls_first()) for n, label in LABELS.items()}}
    if not materialize:
        frames = lazy_frames(events, cur, prev, source, grain, bulk_min, patterns, product_k, breakdown_k, bulk_k, store_sources)
        folder = counted = None
    else:
        spark, shared = events.sparkSession, checkpoint_dir(events.sparkSession)
        if not shared:
            raise RuntimeError("spark.checkpoint.dir is not set; use materialize=False for lazy frames")
        folder = f"{shared}/tidemark-render-{uuid.uuid4().hex}"

        def written(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
            def write(name: str) -> None:
                frames[name].write.parquet(f"{folder}/{name}")

            # Threads that take over the caller's job group, so that a render can be cancelled as one.
            with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
                list(pool.map(inheritable_thread_target(spark)(write), frames))
            return {name: spark.read.parquet(f"{folder}/{name}") for name in frames}

        counted = Observation()
        base = written(event_frames(events, cur, prev, bulk_min, patterns, product_k, breakdown_k, bulk_k, counted))
        frames = {n: base[n] for n in ("products", "channels", "bulk_items")} | written(
            derived_frames(base["grain"], base["labels"], cur, prev, source, grain, bulk_min, patterns, breakdown_k, store_sources))
        frames = {name: df.orderBy(*order[name]) for name, df in frames.items()}
    return Dashboard(
        derived=kpi_derived(frames["summary"]),
        alerts=change_alerts(frames["summary"], frames["products"], frames["channels"], frames["demographics"],
                             frames["regions"], thresholds),
        folder=folder,
        accounting=counted.get if counted else None,
        **frames,
    )
