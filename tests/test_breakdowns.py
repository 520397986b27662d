from tidemark import (Period, bulk_order_items, channel_performance, demographic_performance, device_performance,
                      geo_performance, normalize_demographics, product_performance, product_post, revenue_share)
from tidemark.testing.frames import event, events_frame

CUR, PREV = Period("20240110", "20240112"), Period("20240101", "20240103")


def test_device_null_rows_split_or_merged(spark):
    rows = [event("20240110", 1, name="purchase", rev=10, device=None),
            event("20240101", 2, name="purchase", rev=4, device=None),
            event("20240110", 3, name="purchase", rev=5, device="mobile")]
    ev = events_frame(spark, rows)
    split = [(r.device, r.current_revenue, r.previous_revenue) for r in device_performance(ev, CUR, PREV).collect()]
    assert sorted(split, key=str) == sorted([(None, 10.0, 0.0),
                                             (None, 0.0, 4.0),
                                             ("mobile", 5.0, 0.0)], key=str)
    merged = device_performance(ev, CUR, PREV, null_safe=True).collect()
    assert len(merged) == 2


def test_geo_unknown_default_and_pct_null_on_zero(spark):
    rows = [event("20240110", 1, name="purchase", rev=10, country=None, city="Seoul"),
            event("20240101", 2, name="purchase", rev=None, country="KR", city="Busan")]
    got = {r.location: r for r in geo_performance(events_frame(spark, rows), CUR, PREV).collect()}
    assert got["Unknown / Seoul"].revenue_change_pct is None
    assert got["KR / Busan"].previous_revenue == 0.0  # all-NULL revenue still yields a row


def test_product_latest_name_and_null_rules(spark):
    rows = [
        event("20240101", 1, name="purchase", items=[("p1", "Old name", "C", 10, 2)]),
        event("20240111", 2, name="view_item", items=[("p1", "New name", "C", 10, 1)]),
        event("20240111", 3, name="purchase", items=[("p1", "New name", "C", None, 3), (None, "x", "C", 5, 5)]),
        event("20240110", 4, name="purchase", items=[("p2", "Zero", "C", 0, 1)]),
    ]
    got = product_performance(events_frame(spark, rows), CUR, PREV).collect()
    assert len(got) == 1  # NULL id dropped; zero-revenue product filtered out
    r = got[0]
    assert r.product_name == "New name"
    assert (r.current_revenue, r.previous_revenue, r.current_quantity, r.previous_quantity) == \
        (0.0, 20.0, 3, 2)  # N9: NULL price counts as 0 revenue
    assert (r.current_sessions, r.previous_sessions) == (1, 1)


def test_product_post_zero_revenue_share(spark):
    rows = [event("20240101", 1, name="purchase", items=[("p1", "A", "C", 10, 1)])]
    post = product_post(product_performance(events_frame(spark, rows), CUR, PREV)).collect()
    assert post[0].revenue_share == 0.0 and post[0].revenue_change_pct == -100.0  # N16: share 0, no failure
    rows = [event("20240110", 1, name="purchase", items=[("p1", "A", "C", 10, 1)])]
    post = product_post(product_performance(events_frame(spark, rows), CUR, PREV)).collect()
    assert post[0].revenue_share == 100.0 and post[0].revenue_change_pct == 0.0  # NULL pct filled with 0


def test_bulk_items_ignore_null_factor(spark):
    rows = [event("20240110", 1, name="purchase", tx="T1", rev=5000,
                  items=[("p1", "A", "C", None, 2), ("p1", "A", "C", 10, 3)]),
            event("20240110", 2, name="purchase", tx="T2", rev=10, items=[("p1", "A", "C", 10, 1)])]
    got = bulk_order_items(events_frame(spark, rows), CUR, 1000).collect()
    assert [(r.product_name, r.order_count, r.total_quantity, r.item_revenue) for r in got] == \
        [("A", 1, 5, 30.0)]
    shared = revenue_share(bulk_order_items(events_frame(spark, rows), CUR, 1000), "product_name",
                           "item_revenue").collect()
    assert (shared[0].rank, shared[0].revenue_share) == (1, 100.0)


def test_demographic_normalisation(spark):
    rows = [
        event(params=[("gender", "M ", None)]),  # N18: not trimmed -> Unknown
        event(params=[("age", "", None)], props=[("age_group", "20-29", None), ("u_gender", "FEMALE", None)]),  # N17
        event(props=[("sex", "1", None), ("user_age", "30-39", None)]),
        event(),
    ]
    got = [(r.gender, r.age) for r in normalize_demographics(events_frame(spark, rows)).collect()]
    assert got == [("Unknown", "Unknown"), ("Female", "Unknown"), ("Male", "30-39"), ("Unknown", "Unknown")]


def test_demographic_and_channel_breakdowns(spark):
    rows = [
        event("20240110", 1, "u1", "purchase", rev=100, sid=1, props=[("u_gender", "male", None)],
              ts_source=" Naver ", ts_medium=""),
        event("20240110", 0, "u1", "page_view", sid=1, ts_source=None, ts_medium="CPC"),
        event("20240101", 1, "u2", "purchase", rev=40, sid=2, ts_source="google", ts_medium="organic"),
    ]
    ev = events_frame(spark, rows)
    ch = {r.channel: r for r in channel_performance(ev, CUR, PREV).collect()}
    assert set(ch) == {"naver / cpc", "google / organic"}  # first non-blank value per session, trimmed
    assert (ch["naver / cpc"].current_revenue, ch["naver / cpc"].current_sessions) == (100.0, 1)
    assert ch["google / organic"].sessions_change_pct == -100.0
    dm = {r.demographic: r for r in demographic_performance(ev, CUR, PREV).collect()}
    assert dm["Male / Unknown"].current_revenue == 100.0
    assert dm["Unknown / Unknown"].previous_revenue == 40.0


def test_fill_zero_option(spark):
    rows = [event("20240110", 1, name="purchase", rev=10, device="mobile", country="KR", city="Seoul")]
    ev = events_frame(spark, rows)
    assert geo_performance(ev, CUR, PREV).first().revenue_change_pct is None
    assert geo_performance(ev, CUR, PREV, fill_zero=True).first().revenue_change_pct == 0.0
    assert device_performance(ev, CUR, PREV, fill_zero=True).first().revenue_change_pct == 0.0
    got = geo_performance(ev, CUR, PREV, strategy="outer_join").first()
    assert (got.location, got.current_revenue, got.revenue_change_pct) == ("KR / Seoul", 10.0, None)


def test_sessions_with_negative_ids_are_told_apart(spark):
    """User 'a-' with id 5 and user 'a' with id -5 are two sessions, though joined by '-' they read alike."""
    rows = [event("20240110", 1, user="a-", sid=5), event("20240110", 2, user="a", sid=-5),
            event("20240110", 3, user="a", sid=-5), event("20240110", 4, user=None, sid=1), event("20240110", 5, user="a", sid=None)]
    ev = events_frame(spark, rows)
    assert [r.current_sessions for r in channel_performance(ev, CUR, PREV).collect()] == [2]
    assert [r.current_sessions for r in demographic_performance(ev, CUR, PREV).collect()] == [2]


def test_uncut_products_and_bulk_items(spark):
    rows = [event("20240110", i, name="purchase", tx=f"t{i}", rev=100, items=[(f"p{i}", f"n{i}", "C", 10 + i, 1)]) for i in range(30)]
    ev = events_frame(spark, rows)
    assert len(product_performance(ev, CUR, PREV).collect()) == 20
    assert len(product_performance(ev, CUR, PREV, k=None).collect()) == 30
    assert len(bulk_order_items(ev, CUR, 100, k=None).collect()) == 30
    top = revenue_share(product_performance(ev, CUR, PREV, k=None), "product_name", k=3).collect()
    whole = revenue_share(product_performance(ev, CUR, PREV, k=None), "product_name").collect()
    assert top == whole[:3] and [r.rank for r in top] == [1, 2, 3]


def test_rows_come_in_display_order(spark):
    rows = [event("20240110", i, name="purchase", rev=r, device=d) for i, (d, r) in enumerate([("a", 1), ("b", 9), (None, 5), ("c", 9)])]
    got = [r.device for r in device_performance(events_frame(spark, rows), CUR, PREV, null_safe=True).collect()]
    assert got == ["b", "c", None, "a"]
