"""The render's ranks, shares, parameters and folder; derived KPIs and membership from small frames."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark import Period, dashboard, kpi_derived, kpi_summary, not_in_null_aware
from tidemark.sources.fixtures import build_events
from tidemark.testing.frames import event, events_frame
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV, SF_SMALL



@pytest.fixture(scope="module")
def render(spark):
    d = dashboard(build_events(spark, SF_SMALL), CUR, PREV, "all", "weekly", BULK_MIN, PATTERNS, product_k=7, breakdown_k=4)
    yield d
    d.close()


@pytest.mark.parametrize("name,revenue", [("products", "current_revenue"), ("channels", "current_revenue"),
                                          ("regions", "current_revenue"), ("devices", "current_revenue"),
                                          ("demographics", "current_revenue"), ("bulk_items", "item_revenue")])
def test_every_breakdown_has_rank_and_share(render, name, revenue):
    rows = getattr(render, name).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    total = sum(r[revenue] for r in rows)
    assert all(r.revenue_share == pytest.approx(100 * r[revenue] / total, abs=0.051) for r in rows)
    assert all(v is not None for r in rows for c, v in r.asDict().items() if c.endswith("_pct"))
    assert len(rows) <= {"products": 7, "devices": 99, "bulk_items": 20}.get(name, 4)


def test_close_deletes_the_folder(spark):
    d = dashboard(build_events(spark, SF_SMALL), CUR, PREV, store_sources=("google",))
    path = re.sub("^file:", "", d.folder)
    assert os.path.isdir(path)
    d.close()
    assert not os.path.exists(path)


def test_without_a_checkpoint_folder_it_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.dashboard.checkpoint_dir", lambda s: None)
    ev = build_events(spark, SF_SMALL)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        dashboard(ev, CUR, PREV)
    assert dashboard(ev, CUR, PREV, materialize=False).devices.count() > 0


def test_aov_change_comes_from_raw_quotients(spark):
    """0.014 against 0.006: both AOVs round to 0.01, but the change is 133.3 %."""
    summary = spark.createDataFrame(
        [("Current", 1, 1, 1, 1, 1000, 14.0, 0, 0.0, 1000, 14.0), ("Previous", 1, 1, 1, 1, 1000, 6.0, 0, 0.0, 0, 0.0)],
        "type string, users long, new_users long, sessions long, signups long, orders long, revenue double, "
        "bulk_orders long, bulk_revenue double, filtered_orders long, filtered_revenue double")
    rows = {r.kpi: r for r in kpi_derived(summary).collect()}
    assert (rows["aov"].current_value, rows["aov"].previous_value, rows["aov"].delta) == (0.01, 0.01, 133.3)
    assert rows["filtered_aov"].delta == 0.0


def test_store_sources_and_gap_days(spark):
    rows = [event("20240110", 1, user="a", sid=1, source="Shop"), event("20240105", 2, user="b", sid=1, source="web"),
            event("20240101", 3, user="c", sid=1, source="shop")]
    ev, cur, prev = events_frame(spark, rows), Period("20240110", "20240112"), Period("20240101", "20240103")
    got = {r.type: r.users for r in kpi_summary(ev, cur, prev, "store", store_sources=("shop",)).collect()}
    assert got == {"Current": 1, "Previous": 1}
    users = lambda **kw: {r.type: r.users for r in kpi_summary(ev, cur, prev, **kw).collect()}
    assert users() == {"Current": 1, "Previous": 2} and users(gap_as_previous=False) == {"Current": 1, "Previous": 1}
    with pytest.raises(ValueError):
        kpi_summary(ev, cur, prev, "shop")


@pytest.mark.parametrize("members", [[], ["a"], ["a", None], [None], ["a", "a", "b"]])
def test_null_aware_membership_spreads_null_keys(spark, members):
    left = spark.createDataFrame([("a",), ("b",), (None,)] * 50, "k string")
    right = spark.createDataFrame([(m,) for m in members], "r string")
    df = not_in_null_aware(left, "k", right, "r", "kept")
    for r in df.collect():
        want = not members or (r.k is not None and None not in members and r.k not in members)
        assert r.kept == want
    assert df.count() == 150 and df.columns == ["k", "kept"]
    salt = F.when(F.col("k").isNull(), F.lit(1)).otherwise(0)
    assert left.where(salt == 1).count() == 50
