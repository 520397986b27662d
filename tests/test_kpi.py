import pytest

from tidemark import (Period, RepairPatterns, kpi_derived, kpi_summary, session_first_source, filter_sessions,
                      trend, trend_conversion)
from tidemark.operators.orders import not_in_null_aware, repair_only_orders
from tidemark.testing.frames import event, events_frame

CUR, PREV = Period("20240110", "20240112"), Period("20240101", "20240103")
PATS = RepairPatterns("EASY.REPAIR", "pad|wheel")
REPAIR_ITEM = ("i1", "wheel", "PARTS", 10, 1)
CHAIR_ITEM = ("i2", "chair", "CHAIR", 100, 1)


def _kpi(spark, rows, source="all", bulk=1000):
    out = kpi_summary(events_frame(spark, rows), CUR, PREV, source, bulk, PATS).collect()
    return {r.type: r for r in out}


def test_basic_counts_and_gap_day(spark):
    rows = [
        event("20240110", 1, "u1", "page_view", sid=1, s_num=1),
        event("20240110", 2, "u1", "purchase", tx="T1", rev=50, sid=1, items=[CHAIR_ITEM]),
        event("20240111", 3, "u1", "purchase", tx="T1", rev=50, sid=1, items=[CHAIR_ITEM]),  # N20
        event("20240111", 4, "u2", "sign_up", sid=None),  # N6: no session id
        event("20240105", 5, "u3", "page_view", sid=3),  # gap day -> Previous (N2)
    ]
    k = _kpi(spark, rows)
    c, p = k["Current"], k["Previous"]
    assert (c.users, c.new_users, c.sessions, c.signups, c.orders) == (2, 1, 1, 1, 1)
    assert c.revenue == 100.0  # repeated purchase counted twice in revenue
    assert (p.users, p.sessions, p.orders, p.revenue) == (1, 1, 0, 0.0)
    assert (c.filtered_orders, c.filtered_revenue) == (1, 100.0)


def test_bulk_orders(spark):
    rows = [event("20240110", 1, "u1", "purchase", tx="T1", rev=2000, items=[CHAIR_ITEM]),
            event("20240110", 2, "u1", "purchase", tx="T2", rev=999, items=[CHAIR_ITEM])]
    c = _kpi(spark, rows)["Current"]
    assert (c.bulk_orders, c.bulk_revenue) == (1, 2000.0)


def test_not_in_with_null_in_repair_set_zeroes_filtered(spark):
    # N5: the NULL transaction is repair-only, so every NOT IN is unknown
    rows = [event("20240110", 1, "u1", "purchase", tx=None, rev=10, items=[REPAIR_ITEM]),
            event("20240110", 2, "u1", "purchase", tx="T2", rev=100, items=[CHAIR_ITEM])]
    c = _kpi(spark, rows)["Current"]
    assert (c.orders, c.filtered_orders, c.filtered_revenue) == (1, 0, 0.0)


def test_not_in_with_empty_repair_set_keeps_null_tx_revenue(spark):
    rows = [event("20240110", 1, "u1", "purchase", tx=None, rev=10, items=[CHAIR_ITEM]),
            event("20240110", 2, "u1", "purchase", tx="T2", rev=100, items=[CHAIR_ITEM])]
    c = _kpi(spark, rows)["Current"]
    assert (c.filtered_orders, c.filtered_revenue) == (1, 110.0)


def test_repair_only_excludes_order(spark):
    rows = [event("20240110", 1, "u1", "purchase", tx="T1", rev=10, items=[REPAIR_ITEM, ("i3", None, "X", 1, 1)]),
            event("20240110", 2, "u1", "purchase", tx="T2", rev=100, items=[CHAIR_ITEM, REPAIR_ITEM])]
    c = _kpi(spark, rows)["Current"]
    assert (c.filtered_orders, c.filtered_revenue) == (1, 100.0)
    got = {r.transaction_id for r in repair_only_orders(events_frame(spark, rows), None, PATS).collect()}
    assert got == {"T1"}  # NULL-name item is ignored (N10); T2 has a non-repair item


def test_repair_pattern_case_rules(spark):
    items = [("a", "Easy Repair kit", "X", 1, 1)]  # upper-cased name matches EASY.REPAIR
    items2 = [("b", "WHEEL", "X", 1, 1)]  # raw-name pattern is case-sensitive
    rows = [event("20240110", 1, "u1", "purchase", tx="T1", items=items),
            event("20240110", 2, "u1", "purchase", tx="T2", items=items2)]
    got = {r.transaction_id for r in repair_only_orders(events_frame(spark, rows), None, PATS).collect()}
    assert got == {"T1"}


def test_not_in_null_aware_three_cases(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    def kept(right_rows):
        right = spark.createDataFrame(right_rows, "k string")
        return {r.k: r.kept for r in not_in_null_aware(left, "k", right, "k", "kept").collect()}
    assert kept([("a",)]) == {"a": False, "b": True, None: False}
    assert kept([("a",), (None,)]) == {"a": False, "b": False, None: False}
    assert kept([]) == {"a": True, "b": True, None: True}


def test_source_modes_split_sessions(spark):
    rows = [
        event("20240110", 1, "u1", "page_view", sid=1, source="QR_Store_247486"),
        event("20240110", 2, "u1", "purchase", tx="T1", rev=10, sid=1, source="google", items=[CHAIR_ITEM]),
        event("20240110", 3, "u2", "purchase", tx="T2", rev=20, sid=2, items=[CHAIR_ITEM]),
        event("20240110", 4, "u3", "purchase", tx="T3", rev=40, sid=None, items=[CHAIR_ITEM]),
    ]
    store, online, allm = (_kpi(spark, rows, s)["Current"] for s in ("store", "online", "all"))
    assert (store.sessions, store.revenue) == (1, 10.0)
    assert (online.sessions, online.revenue) == (1, 20.0)
    assert allm.revenue == 70.0  # N6: the NULL-sid event only counts in "all"


def test_first_source_rules(spark):
    rows = [
        event("20240110", 5, "u1", sid=1, source="B"),
        event("20240110", 5, "u1", sid=1, source="a"),  # tie on time: smallest value wins
        event("20240110", 1, "u2", sid=2, source="", ts_source="google"),  # '' is kept (N7)
        event("20240110", 1, "u3", sid=3, ts_source="Naver"),
        event("20240110", 1, "u4", sid=4),
        event("20240110", 1, "u5", sid=5, source="qr_store_x"),
    ]
    fs = {r.user_pseudo_id: r.first_source for r in session_first_source(events_frame(spark, rows)).collect()}
    assert fs == {"u1": "a", "u2": "", "u3": "naver", "u4": "(direct)", "u5": "qr_store_x"}
    store = filter_sessions(session_first_source(events_frame(spark, rows)), ["qr_store_"]).collect()
    assert store == []  # exact match, not a prefix


def test_no_previous_row_uses_current(spark):
    rows = [event("20240110", 1, "u1", "purchase", tx="T1", rev=10, items=[CHAIR_ITEM])]
    d = {r.kpi: r for r in kpi_derived(kpi_summary(events_frame(spark, rows), CUR, PREV, "all", 1000, PATS)).collect()}
    assert d["revenue"].previous_value == 10.0 and d["revenue"].delta == 0.0
    assert d["aov"].current_value == 10.0 and d["conversion_rate"].current_value == 100.0


def test_no_current_row_gives_empty_derived(spark):
    rows = [event("20240101", 1, "u1", "page_view")]
    assert kpi_derived(kpi_summary(events_frame(spark, rows), CUR, PREV, "all", 1000, PATS)).count() == 0


def test_trend_grains_and_conversion(spark):
    rows = [event("20240113", 1, "u1", "purchase", tx="T1", rev=10, sid=1),  # Saturday
            event("20240114", 2, "u1", "page_view", sid=2),  # Sunday starts a week
            event("20240114", 3, "u2", "page_view", sid=None)]
    cur = Period("20240110", "20240120")
    w = {r.period_label: r for r in trend(events_frame(spark, rows), cur, "weekly").collect()}
    assert set(w) == {"2024-01-07", "2024-01-14"}
    assert (w["2024-01-07"].sessions, w["2024-01-07"].orders) == (1, 1)
    m = trend(events_frame(spark, rows), cur, "monthly").collect()
    assert [r.period_label for r in m] == ["2024-01-01"]
    conv = {r.period_label: r.conversion_rate for r in trend_conversion(trend(events_frame(spark, rows), cur)).collect()}
    assert conv == {"2024-01-13": 100.0, "2024-01-14": 0.0}
    with pytest.raises(ValueError):
        trend(events_frame(spark, rows), cur, "hourly")


def test_session_key_without_separator_collides(spark):
    # N13: 'u1'+'23' and 'u12'+'3' give one distinct concatenated key
    rows = [event("20240110", 1, "u1", sid=23), event("20240110", 2, "u12", sid=3)]
    assert _kpi(spark, rows)["Current"].sessions == 1


def test_overlapping_periods_count_once_in_summary_twice_in_breakdowns(spark):
    # N3: an event inside both periods is Current in the summary but counts in both breakdown periods
    from tidemark import channel_performance
    cur, prev = Period("20240110", "20240112"), Period("20240111", "20240113")
    rows = [event("20240111", 1, "u1", "purchase", tx="T1", rev=10, sid=1, items=[CHAIR_ITEM])]
    ev = events_frame(spark, rows)
    k = {r.type: r for r in kpi_summary(ev, cur, prev, "all", 1000, PATS).collect()}
    assert set(k) == {"Current"} and k["Current"].revenue == 10.0
    ch = channel_performance(ev, cur, prev).first()
    assert (ch.current_revenue, ch.previous_revenue, ch.current_sessions, ch.previous_sessions) == \
        (10.0, 10.0, 1, 1)


def test_source_trend_attributes_over_current_period_only(spark):
    # N12: the session started from a store source in the comparison range, then continued online;
    # the summary (covering range) calls it a store session, the trend (current only) an online one
    rows = [event("20240103", 1, "u1", "page_view", sid=5, source="QR_Store_247486"),
            event("20240110", 2, "u1", "page_view", sid=5, source="google")]
    ev = events_frame(spark, rows)
    store_kpi = {r.type: r for r in kpi_summary(ev, CUR, PREV, "store", 1000, PATS).collect()}
    assert store_kpi["Current"].sessions == 1
    assert trend(ev, CUR, "daily", "store").collect() == []
    assert [r.sessions for r in trend(ev, CUR, "daily", "online").collect()] == [1]
