"""Hand-made nested events for unit tests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.events import EVENTS_SCHEMA


def _dec(x):
    return None if x is None else Decimal(str(x))


def event(date: str = "20240110", ts: int = 0, user: str | None = "u1", name: str = "page_view",
          tx: str | None = None, rev=None, sid: int | None = 1, s_num: int | None = 2,
          source: str | None = None, params: list[tuple] | None = None, props: list[tuple] | None = None,
          items: list[tuple] | None = None, ts_source: str | None = None, ts_medium: str | None = None,
          country: str | None = None, city: str | None = None, device: str | None = None) -> tuple:
    """One events row.  ``params``/``props`` entries are ``(key, string_value, int_value)``;
    ``items`` entries are ``(item_id, item_name, item_category, price, quantity)``."""
    p = []
    if sid is not None:
        p.append(("ga_session_id", (None, sid)))
    if s_num is not None:
        p.append(("ga_session_number", (None, s_num)))
    if source is not None:
        p.append(("source", (source, None)))
    p += [(k, (sv, iv)) for k, sv, iv in (params or [])]
    up = [(k, (sv, iv)) for k, sv, iv in (props or [])]
    its = [(i, n, c, _dec(pr), q) for i, n, c, pr, q in (items or [])]
    return (ts, user, name, (tx, _dec(rev)), p, up, its, (ts_source, ts_medium), (country, city), (device,), date)


def events_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, EVENTS_SCHEMA)
