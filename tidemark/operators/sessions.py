"""Session attribution: first source of a session, session filtering, channels.

Sessions are ``(user_pseudo_id, sid)`` groups; NULL ``sid`` values form one
group per user, as a window partition would.  Attribution is a ``groupBy``
with ``min`` over ``struct(event_timestamp, value)`` instead of a window: the
aggregate combines map-side, so a session holding a huge share of the events
never has to sit in one task.  Ties on the timestamp resolve to the smallest
value, deterministically.  An event without a time counts only where its
source has no event with one in that session; such a source sorts first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank_to_null
from tidemark.plans.periods import Period
from tidemark.plans.prepare import prepare
from tidemark.sources.events import scan

# Session-start sources that count as in-store (exact match).
STORE_SOURCES = (
    "qr_store_247486", "qr_store_247482", "qr_store_252941", "qr_store_247476",
    "store_register_qr", "qr_store_247483", "qr_store_247488", "qr_store_247474",
    "qr_store_247489", "qr_store_247475", "qr_store_247485", "qr_store_",
)
DIRECT = "(direct)"
NO_MEDIUM = "(none)"
SESSION_KEY = ["user_pseudo_id", "sid"]


def earliest(value: Column, ts: Column | str = "event_timestamp") -> Column:
    """Aggregate: value of the earliest row (ties: smallest value); NULL values skipped."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.min(F.when(value.isNotNull(), F.struct(ts.alias("t"), value.alias("v"))))["v"]


def source_of_event() -> Column:
    """``lower(coalesce(param source, traffic_source.source, '(direct)'))``; '' is kept."""
    return F.lower(F.coalesce(F.col("param_source"), F.col("ts_source"), F.lit(DIRECT)))


def session_first_source(events: DataFrame, period: Period | None = None) -> DataFrame:
    """``(user_pseudo_id, sid, first_source)``: source of each session's first event.

    Two aggregation levels: a hash aggregate on ``(user, sid, source)`` keeps
    each distinct source's earliest time (string keys hash fine, only string
    *buffers* force sort-based aggregation), then the sort-based "earliest
    value" aggregate runs on those few rows per session.
    """
    src = scan(events, period) if period else events
    flat = prepare(src, "user_pseudo_id", "sid", "event_timestamp", "param_source", "ts_source")
    return (flat.groupBy(*SESSION_KEY, source_of_event().alias("_src"))
            .agg(F.min("event_timestamp").alias("_t"))
            .groupBy(*SESSION_KEY)
            .agg(earliest(F.col("_src"), "_t").alias("first_source")))


def filter_sessions(first_source: DataFrame, sources: Iterable[str] = STORE_SOURCES,
                    include: bool = True) -> DataFrame:
    """Sessions whose first source is (``include``) or is not in ``sources``."""
    member = F.col("first_source").isin(*list(sources))
    return first_source.where(member if include else ~member).select(*SESSION_KEY)


def channel_source() -> Column:
    return F.lower(blank_to_null(F.col("ts_source")))


def channel_medium() -> Column:
    return F.lower(blank_to_null(F.col("ts_medium")))


def session_channels(events: DataFrame, period: Period | None = None) -> DataFrame:
    """``(user_pseudo_id, sid, channel)``: first non-blank source / medium of each session."""
    src = scan(events, period) if period else events
    flat = prepare(src, "user_pseudo_id", "sid", "event_timestamp", "ts_source", "ts_medium")
    return (channel_grain(flat)
            .groupBy(*SESSION_KEY)
            .agg(earliest(F.col("_s"), "_t").alias("_s"), earliest(F.col("_m"), "_t").alias("_m"))
            .select(*SESSION_KEY, channel_label(F.col("_s"), F.col("_m")).alias("channel")))


def channel_grain(flat: DataFrame, **sums: Column) -> DataFrame:
    """Hash pre-aggregation on ``(user, sid, clean source, clean medium)``: earliest time plus ``sums``.

    The per-session "first non-blank value" aggregate that follows is sort-based
    (string buffers); it then sees one row per distinct (source, medium) of a
    session instead of one row per event.
    """
    return (flat.groupBy(*SESSION_KEY, channel_source().alias("_s"), channel_medium().alias("_m"))
            .agg(F.min("event_timestamp").alias("_t"), *[c.alias(k) for k, c in sums.items()]))


def channel_label(first_src: Column, first_medium: Column) -> Column:
    return F.concat(F.coalesce(first_src, F.lit(DIRECT)), F.lit(" / "), F.coalesce(first_medium, F.lit(NO_MEDIUM)))
