"""Randomised cross-check: kpi_summary vs the DuckDB oracle SQL on the same random events.

Events are drawn with many NULLs, repeated transactions, missing sessions,
repair-only and NULL-name items and gap days; the oracle runs the flat SQL
over the same rows loaded into DuckDB tables.
"""

from decimal import Decimal

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark import kpi_summary
from tidemark.testing import oracle
from tidemark.testing.compare import canonical
from tidemark.testing.frames import event, events_frame
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV

DATES = ["20240101", "20240110", "20240115", "20240116", "20240130"]
NAMES = [None, "red ring", "blue plate", "PROMO gizmo"]  # 'ring' and 'PROMO' are repair matches
FLAT_FROM_TABLES = """
items_x AS (SELECT * FROM items_tbl),
ev AS (SELECT * FROM ev_tbl),
ev_items AS (SELECT ev.*, i.item_id, i.item_name, i.item_category, i.price, i.quantity
             FROM ev JOIN items_x i ON i.order_key = ev.event_id WHERE ev.has_items)"""

item_st = st.tuples(st.sampled_from(["P1", "P2", None]), st.sampled_from(NAMES), st.sampled_from(["X", "PROMO"]),
                    st.sampled_from([10, 500000, None]), st.sampled_from([1, 2, None]))
event_st = st.fixed_dictionaries({
    "date": st.sampled_from(DATES), "ts": st.integers(0, 5), "user": st.sampled_from(["u1", "u2", "u12", None]),
    "name": st.sampled_from(["purchase", "purchase", "sign_up", "page_view"]),
    "tx": st.sampled_from(["T1", "T2", "T3", None]), "rev": st.sampled_from([None, 100, 450000]),
    "sid": st.sampled_from([1, 3, 23, None]), "s_num": st.sampled_from([1, 2, None]),
    "source": st.sampled_from([None, "QR_Store_247486", "google", ""]),
    "ts_source": st.sampled_from([None, "naver"]),
    "items": st.lists(item_st, max_size=3),
})


def _flat_tables(rows):
    ev, items = [], []
    for i, r in enumerate(rows):
        has_items = r["name"] == "purchase" and bool(r["items"])
        ev.append({"event_id": i, "event_date": r["date"], "event_timestamp": r["ts"], "user_pseudo_id": r["user"],
                   "event_name": r["name"], "transaction_id": r["tx"],
                   "purchase_revenue": None if r["rev"] is None else Decimal(r["rev"]),
                   "sid": r["sid"], "s_num": r["s_num"], "param_source": r["source"], "ts_source": r["ts_source"],
                   "has_items": has_items})
        for it in r["items"] if has_items else []:
            items.append({"order_key": i, "item_id": it[0], "item_name": it[1], "item_category": it[2],
                          "price": None if it[3] is None else Decimal(it[3]), "quantity": it[4]})
    evdf = pd.DataFrame(ev).astype({"sid": "Int64", "s_num": "Int64", "event_timestamp": "int64"})
    itdf = pd.DataFrame(items, columns=["order_key", "item_id", "item_name", "item_category", "price", "quantity"])
    return evdf, itdf.astype({"quantity": "Int64", "order_key": "int64"})


@settings(max_examples=int(__import__("os").environ.get("KPI_EXAMPLES", "12")), deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(event_st, min_size=1, max_size=12), st.sampled_from(["all", "store", "online"]))
def test_kpi_matches_oracle_on_random_events(spark, rows, source):
    nested = events_frame(spark, [
        event(r["date"], r["ts"], r["user"], r["name"], tx=r["tx"], rev=r["rev"], sid=r["sid"], s_num=r["s_num"],
              source=r["source"], ts_source=r["ts_source"],
              items=r["items"] if r["name"] == "purchase" else [])
        for r in rows])
    got = kpi_summary(nested, CUR, PREV, source, BULK_MIN, PATTERNS)
    evdf, itdf = _flat_tables(rows)
    con = duckdb.connect()
    con.register("ev_src", evdf)
    con.register("items_src", itdf)
    con.execute("CREATE TABLE ev_tbl AS SELECT event_id, event_date, event_timestamp, user_pseudo_id, event_name, "
                "transaction_id, CAST(purchase_revenue AS DECIMAL(18,2)) AS purchase_revenue, "
                "CAST(sid AS BIGINT) AS sid, CAST(s_num AS BIGINT) AS s_num, param_source, ts_source, has_items "
                "FROM ev_src")
    con.execute("CREATE TABLE items_tbl AS SELECT CAST(order_key AS BIGINT) AS order_key, item_id, item_name, "
                "item_category, CAST(price AS DECIMAL(18,2)) AS price, CAST(quantity AS BIGINT) AS quantity "
                "FROM items_src")
    res = con.execute(oracle.kpi_sql(source, flat=FLAT_FROM_TABLES))
    want = canonical([d[0] for d in res.description], res.fetchall())
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == want
