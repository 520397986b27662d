"""tidemark: period-over-period web and commerce analytics on Spark DataFrames.

Every public operator takes a GA4-style nested events DataFrame (see
``tidemark.sources.events.EVENTS_SCHEMA``) plus plain Python parameters and
returns a lazy DataFrame built only from built-in Spark expressions, so
Catalyst and AQE plan the whole thing.
"""

from tidemark.plans.periods import Period
from tidemark.sources.events import EVENTS_SCHEMA, read_events, scan, write_bucketed, write_events, write_shards
from tidemark.operators.distinct import (
    bitmap_counts, daily_sketches, daily_user_bitmaps, extend_users, read_users, sketch_counts)
from tidemark.operators.grain import daily_grain, read_grain, refresh_grain
from tidemark.operators.kpi import grain_kpi_summary, grain_trend, kpi_summary, trend, trend_conversion, kpi_derived
from tidemark.operators.sessions import session_first_source, filter_sessions, session_channels
from tidemark.operators.orders import not_in_null_aware, repair_only_orders, RepairPatterns
from tidemark.operators.breakdowns import (
    product_performance,
    product_post,
    channel_performance,
    geo_performance,
    device_performance,
    demographic_performance,
    normalize_demographics,
    latest_item_names,
    label_breakdowns,
    geo_of,
    device_of,
    demographic_of,
)
from tidemark.operators.bulk import bulk_order_items
from tidemark.operators.alerts import revenue_share, change_alerts, AlertThresholds
from tidemark.operators.dashboard import Dashboard, dashboard

__all__ = [
    "Period", "EVENTS_SCHEMA", "read_events", "scan", "write_events", "write_shards", "write_bucketed",
    "daily_sketches", "sketch_counts", "extend_users", "read_users", "daily_user_bitmaps", "bitmap_counts",
    "daily_grain", "refresh_grain", "read_grain", "grain_kpi_summary", "grain_trend",
    "kpi_summary", "trend", "trend_conversion", "kpi_derived",
    "session_first_source", "filter_sessions", "session_channels",
    "repair_only_orders", "RepairPatterns", "not_in_null_aware",
    "product_performance", "product_post", "channel_performance", "geo_performance",
    "device_performance", "demographic_performance", "normalize_demographics", "latest_item_names", "label_breakdowns",
    "geo_of", "device_of", "demographic_of",
    "bulk_order_items", "revenue_share", "change_alerts", "AlertThresholds", "Dashboard", "dashboard",
]
