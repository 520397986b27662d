"""Cross-operator invariants on the mid-size fixture."""

from decimal import Decimal

import pytest

from tidemark import kpi_summary, product_performance, product_post, trend
from tidemark.sources.fixtures import build_events
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV, SF_MID



@pytest.fixture(scope="module")
def ev(spark):
    return build_events(spark, SF_MID).cache()


def test_store_plus_online_equals_sessionised_all(ev):
    from pyspark.sql import functions as F
    from tidemark.plans.prepare import prepare
    k = {s: {r.type: r for r in kpi_summary(ev, CUR, PREV, s, BULK_MIN, PATTERNS).collect()}
         for s in ("store", "online")}
    with_session = prepare(ev, "event_date", "user_pseudo_id", "sid", "purchase_revenue") \
        .where(F.col("sid").isNotNull() & F.col("user_pseudo_id").isNotNull() & CUR.contains("event_date"))
    expect = with_session.agg(F.sum(F.coalesce("purchase_revenue", F.lit(0)))).first()[0]
    assert Decimal(str(k["store"]["Current"].revenue)) + Decimal(str(k["online"]["Current"].revenue)) == expect


def test_daily_trend_sums_to_current_revenue(ev):
    cur = {r.type: r for r in kpi_summary(ev, CUR, PREV, "all", BULK_MIN, PATTERNS).collect()}["Current"]
    daily = trend(ev, CUR, "daily").collect()
    monthly = trend(ev, CUR, "monthly").collect()
    exact = lambda rows: sum((Decimal(str(r.revenue)) for r in rows), Decimal(0))
    assert exact(daily) == Decimal(str(cur.revenue)) == exact(monthly)
    assert len(daily) == 15


def test_product_share_sums_to_100(ev):
    shares = [r.revenue_share for r in product_post(product_performance(ev, CUR, PREV)).collect()]
    assert abs(sum(shares) - 100.0) <= 0.05 * len(shares)


def test_dashboard_render_matches_individual_queries(spark, ev):
    from tidemark import change_alerts, channel_performance, dashboard, demographic_performance, geo_performance
    from tidemark.testing.params import THRESHOLDS
    d = dashboard(ev, CUR, PREV, "all", "weekly", BULK_MIN, PATTERNS, THRESHOLDS)
    direct = change_alerts(kpi_summary(ev, CUR, PREV, "all", BULK_MIN, PATTERNS),
                           product_post(product_performance(ev, CUR, PREV)), channel_performance(ev, CUR, PREV),
                           demographic_performance(ev, CUR, PREV), geo_performance(ev, CUR, PREV), THRESHOLDS)
    assert sorted(map(tuple, d.alerts.collect()), key=str) == sorted(map(tuple, direct.collect()), key=str)
    assert d.alerts.count() > 0
    assert [r.period_label for r in d.trend.collect()] == ["2024-01-14", "2024-01-21", "2024-01-28"]
    assert {r.kpi for r in d.derived.collect()} >= {"revenue", "aov", "conversion_rate"}
    assert set(d.frames()) == {"summary", "derived", "trend", "products", "channels", "regions", "devices",
                               "demographics", "bulk_items", "alerts"}


def test_lazy_dashboard_equals_materialised(spark, ev):
    from tidemark import dashboard
    from tidemark.testing.params import THRESHOLDS
    lazy = dashboard(ev, CUR, PREV, "store", "monthly", BULK_MIN, PATTERNS, THRESHOLDS, materialize=False)
    done = dashboard(ev, CUR, PREV, "store", "monthly", BULK_MIN, PATTERNS, THRESHOLDS, parallelism=2)
    for name in ("summary", "trend", "alerts", "derived"):
        a = sorted(map(tuple, getattr(lazy, name).collect()), key=str)
        b = sorted(map(tuple, getattr(done, name).collect()), key=str)
        assert a == b, name


def test_registered_device_share_has_every_device(spark, monkeypatch):
    from tidemark.testing import queries
    frame = spark.range(150).selectExpr("concat('d', id) AS device", "CAST(id AS double) AS current_revenue")
    monkeypatch.setattr(queries, "_ev", lambda s, d: None)
    monkeypatch.setattr(queries.breakdowns, "device_performance", lambda *a, **k: frame)
    assert queries.registry()["q18_revenue_share_device"](spark, "").count() == 150
