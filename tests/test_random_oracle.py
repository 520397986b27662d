"""Randomised cross-check of every breakdown against the DuckDB oracle on the same random events.

Random events (NULLs everywhere, repeated transactions, missing sessions, blank
and whitespace sources, NULL devices and countries, demographic parameters in
event params or user properties, items on any event) are built once as a
nested Spark frame and once as flat DuckDB tables; each operator's result is
compared with the oracle SQL run over the flat tables.
"""

import os
from decimal import Decimal

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark import (bulk_order_items, channel_performance, demographic_performance, device_performance,
                      geo_performance, kpi_summary, product_performance, repair_only_orders, session_first_source,
                      trend)
from tidemark.plans.periods import covering
from tidemark.testing import oracle as O
from tidemark.testing.compare import canonical
from tidemark.testing.frames import event, events_frame
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV

DATES = ["20240101", "20240110", "20240115", "20240116", "20240121", "20240130"]
FLAT_FROM_TABLES = """
items_x AS (SELECT * FROM items_tbl),
ev AS (SELECT * FROM ev_tbl),
ev_items AS (SELECT ev.*, i.item_id, i.item_name, i.item_category, i.price, i.quantity
             FROM ev JOIN items_x i ON i.order_key = ev.event_id WHERE ev.has_items)"""

item_st = st.tuples(st.sampled_from(["P1", "P2", "P3", None]),
                    st.sampled_from([None, "red ring", "blue plate", "PROMO gizmo"]),
                    st.sampled_from(["X", "PROMO", None]), st.sampled_from([10, 250000, None]),
                    st.sampled_from([1, 3, None]))
event_st = st.fixed_dictionaries({
    "date": st.sampled_from(DATES), "ts": st.integers(0, 4), "user": st.sampled_from(["u1", "u2", "u12", None]),
    "name": st.sampled_from(["purchase", "purchase", "view_item", "sign_up", "page_view"]),
    "tx": st.sampled_from(["T1", "T2", None]), "rev": st.sampled_from([None, 100, 450000]),
    "sid": st.sampled_from([1, 3, None]), "s_num": st.sampled_from([1, 2, None]),
    "source": st.sampled_from([None, "QR_Store_247486", "google", ""]),
    "ts_source": st.sampled_from([None, "Naver", " ", "google "]),
    "ts_medium": st.sampled_from([None, "CPC", "", "organic"]),
    "country": st.sampled_from([None, "KR", "US"]), "city": st.sampled_from([None, "Seoul"]),
    "device": st.sampled_from([None, "mobile", "desktop"]),
    "ep_gender": st.sampled_from([None, "M", "female", " m"]), "up_gender": st.sampled_from([None, "1", "F"]),
    "ep_age": st.sampled_from([None, "", "20-29"]), "up_age": st.sampled_from([None, "30-39"]),
    "items": st.lists(item_st, max_size=3),
})

FLAT_COLS = ["event_id", "event_date", "event_timestamp", "user_pseudo_id", "event_name", "transaction_id",
             "purchase_revenue", "sid", "s_num", "param_source", "ep_gender", "ep_age", "up_gender", "up_age",
             "ts_source", "ts_medium", "country", "city", "device", "has_items"]


def _nested(spark, rows):
    return events_frame(spark, [
        event(r["date"], r["ts"], r["user"], r["name"], tx=r["tx"], rev=r["rev"], sid=r["sid"], s_num=r["s_num"],
              source=r["source"],
              params=([("gender", r["ep_gender"], None)] if r["ep_gender"] is not None else [])
              + ([("age", r["ep_age"], None)] if r["ep_age"] is not None else []),
              props=([("u_gender", r["up_gender"], None)] if r["up_gender"] is not None else [])
              + ([("age_group", r["up_age"], None)] if r["up_age"] is not None else []),
              items=r["items"], ts_source=r["ts_source"], ts_medium=r["ts_medium"], country=r["country"],
              city=r["city"], device=r["device"])
        for r in rows])


def _duck(rows):
    ev, items = [], []
    for i, r in enumerate(rows):
        ev.append((i, r["date"], r["ts"], r["user"], r["name"], r["tx"],
                   None if r["rev"] is None else Decimal(r["rev"]), r["sid"], r["s_num"], r["source"],
                   r["ep_gender"], r["ep_age"], r["up_gender"], r["up_age"], r["ts_source"], r["ts_medium"],
                   r["country"], r["city"], r["device"], bool(r["items"])))
        items += [(i, *it) for it in r["items"]]
    con = duckdb.connect()
    con.register("ev_src", pd.DataFrame(ev, columns=FLAT_COLS).astype(
        {"sid": "Int64", "s_num": "Int64", "event_timestamp": "int64"}))
    con.register("items_src", pd.DataFrame(items, columns=["order_key", "item_id", "item_name", "item_category",
                                                             "price", "quantity"]).astype({"quantity": "Int64"}))
    con.execute("CREATE TABLE ev_tbl AS SELECT CAST(event_id AS BIGINT) AS event_id, event_date, "
                "CAST(event_timestamp AS BIGINT) AS event_timestamp, CAST(user_pseudo_id AS VARCHAR) AS "
                "user_pseudo_id, event_name, CAST(transaction_id AS VARCHAR) AS transaction_id, "
                "CAST(purchase_revenue AS DECIMAL(18,2)) AS purchase_revenue, CAST(sid AS BIGINT) AS sid, "
                "CAST(s_num AS BIGINT) AS s_num, "
                + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in FLAT_COLS[9:19]) + ", has_items FROM ev_src")
    con.execute("CREATE TABLE items_tbl AS SELECT CAST(order_key AS BIGINT) AS order_key, "
                "CAST(item_id AS VARCHAR) AS item_id, CAST(item_name AS VARCHAR) AS item_name, "
                "CAST(item_category AS VARCHAR) AS item_category, CAST(price AS DECIMAL(18,2)) AS price, "
                "CAST(quantity AS BIGINT) AS quantity FROM items_src")
    return con


def _flat(*ctes):
    return O.with_flat(*ctes, flat=FLAT_FROM_TABLES)


def _same(con, df, sql):
    res = con.execute(sql)
    want = canonical([d[0] for d in res.description], res.fetchall())
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got == want, (got, want)


@settings(max_examples=int(os.environ.get("RANDOM_EXAMPLES", "4")), deadline=None,
          suppress_health_check=list(HealthCheck))
@given(st.lists(event_st, min_size=1, max_size=14))
def test_breakdowns_match_oracle_on_random_events(spark, rows):
    ev = _nested(spark, rows)
    con = _duck(rows)
    base = O._covering_base()
    base_items = ("base_items AS (SELECT b.*, i.item_id, i.item_name, i.item_category FROM base b "
                  "JOIN items_x i ON i.order_key = b.event_id WHERE b.has_items AND b.event_name = 'purchase')")
    repair = (f"repair AS (SELECT transaction_id FROM base_items GROUP BY transaction_id "
              f"HAVING bool_and({O.repair_pred()}))")
    checks = [
        (channel_performance(ev, CUR, PREV), _flat(O.CHANNEL_BODY) + "\nSELECT * FROM chan"),
        (geo_performance(ev, CUR, PREV), _flat(O.GEO_BODY) + "\nSELECT * FROM geo"),
        (geo_performance(ev, CUR, PREV, strategy="outer_join"), _flat(O.GEO_BODY) + "\nSELECT * FROM geo"),
        (device_performance(ev, CUR, PREV), _flat(O.DEVICE_BODY) + "\nSELECT * FROM dev"),
        (demographic_performance(ev, CUR, PREV), _flat(O.DEMO_BODY) + "\nSELECT * FROM demo"),
        (product_performance(ev, CUR, PREV), _flat(O.PRODUCT_BODY) + "\n" + O.PRODUCT_SELECT),
        (bulk_order_items(ev, CUR, BULK_MIN), _flat(O.BULK_BODY) + "\nSELECT * FROM bulk"),
        (trend(ev, CUR, "weekly", "online"), O.trend_sql("weekly", "online").replace(O.FLAT, FLAT_FROM_TABLES)),
        (repair_only_orders(ev, covering(CUR, PREV), PATTERNS),
         _flat(base, base_items, repair) + "\nSELECT transaction_id FROM repair"),
        (session_first_source(ev, covering(CUR, PREV)),
         _flat(base, O.first_source_cte("sfs", "base")) + "\nSELECT * FROM sfs"),
        (kpi_summary(ev, CUR, PREV, "store", BULK_MIN, PATTERNS), O.kpi_sql("store", flat=FLAT_FROM_TABLES)),
    ]
    for df, sql in checks:
        _same(con, df, sql)
