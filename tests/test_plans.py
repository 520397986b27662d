"""Plan-shape checks: partition pruning, nested pruning, no nested-loop existence joins, no Python UDFs."""

import collections
import contextlib
import io
import re
import uuid
from decimal import Decimal

import pytest

from tidemark import (change_alerts, channel_performance, demographic_performance, geo_performance, kpi_summary, product_performance, product_post,
                      read_events, revenue_share, trend, write_events)
from tidemark.operators.dashboard import derived_frames, event_frames
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.fixtures import build_events
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV, SF_SMALL, THRESHOLDS



@pytest.fixture(scope="module")
def events(spark):
    path = f"{ensure_checkpoint_dir(spark)}/test-events-{uuid.uuid4().hex[:8]}"
    write_events(build_events(spark, SF_SMALL), path, partitions=4)
    return read_events(spark, path)


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_partition_filters_reach_scan(events):
    p = plan(geo_performance(events, CUR, PREV))
    part = [line for line in p.splitlines() if "PartitionFilters" in line]
    assert part and "event_date" in part[0] and "20240116" in part[0] and "20240114" in part[0]


def test_param_lookup_reads_only_needed_leaves(events):
    p = plan(kpi_summary(events, CUR, PREV, "all", BULK_MIN, PATTERNS))
    schemas = [line for line in p.splitlines() if "ReadSchema" in line]
    sessions = [s for s in schemas if "event_params" in s]
    commerce = [s for s in schemas if "items" in s]
    # session columns and commerce columns are read by two scans with disjoint columns
    assert sessions and all("event_params:array<struct<key:string,value:struct<int_value:bigint>>>" in s
                            and "items" not in s for s in sessions)
    assert commerce and all("items:array<struct<item_name:string,item_category:string>>" in s
                            and "event_params" not in s for s in commerce)
    assert not any("user_properties" in s or "geo" in s for s in schemas)


def test_no_nested_loop_or_python(events):
    for df in (kpi_summary(events, CUR, PREV, "store", BULK_MIN, PATTERNS), channel_performance(events, CUR, PREV),
               product_performance(events, CUR, PREV)):
        p = plan(df)
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_top_k_is_take_ordered(events):
    from tidemark import bulk_order_items, demographic_performance
    for df in (product_performance(events, CUR, PREV), channel_performance(events, CUR, PREV),
               geo_performance(events, CUR, PREV), demographic_performance(events, CUR, PREV),
               bulk_order_items(events, CUR, BULK_MIN)):
        p = plan(df)
        assert "TakeOrderedAndProject" in p, p
        assert "rangepartitioning" not in p, p  # no global sort of the whole aggregate


@pytest.mark.parametrize("bound", [400_000, 400_000.0, Decimal("400000.001")])
def test_revenue_filter_pushed_down(events, bound):
    from tidemark import bulk_order_items
    p = plan(bulk_order_items(events, CUR, bound))
    pushed = [line for line in p.splitlines() if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(ecommerce.purchase_revenue" in line for line in pushed), pushed


def final_nodes(df) -> collections.Counter:
    """Operators of the plan that ran; a reused exchange is not counted again."""
    df.collect()
    tree = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return collections.Counter(re.findall(r"^[\s:+\-*()0-9]*([A-Z]\w+)", tree, re.M))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("mode", ["store", "online"])
def test_source_modes_read_the_events_twice(events, mode, no_broadcast):
    n = final_nodes(kpi_summary(events, CUR, PREV, mode, BULK_MIN, PATTERNS))
    assert n["FileScan"] <= 2 and n["Exchange"] < 11, n
    assert final_nodes(trend(events, CUR, "weekly", mode))["FileScan"] <= 2


def test_products_are_cut_before_sessions_are_counted(events):
    df = product_performance(events, CUR, PREV)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    join = tree.index("Join Inner")
    assert "GlobalLimit 20" in tree[join:], tree
    assert final_nodes(df)["FileScan"] <= 2


def test_sessions_are_counted_as_rows(events):
    n = final_nodes(channel_performance(events, CUR, PREV))
    assert not n["Expand"] and n["Exchange"] <= 3, n
    assert not final_nodes(demographic_performance(events, CUR, PREV))["Expand"]


def test_alerts_read_each_input_once(events):
    df = change_alerts(kpi_summary(events, CUR, PREV, "all", BULK_MIN, PATTERNS),
                       product_post(product_performance(events, CUR, PREV)), channel_performance(events, CUR, PREV),
                       demographic_performance(events, CUR, PREV), geo_performance(events, CUR, PREV), THRESHOLDS)
    assert final_nodes(df)["FileScan"] <= 7


def test_rank_of_an_uncut_frame_sorts_only_the_top(events):
    frame = channel_performance(events, CUR, PREV, k=None)
    tree = plan(revenue_share(frame, "channel", k=5)).split("== Initial Plan ==")[0].split("\n\n")[0]
    window = tree.index("Window")
    assert "TakeOrdered" in tree[window:] or "GlobalLimit" in tree[window:], tree


def test_a_render_reads_the_events_six_times(events):
    """Whatever the source mode; the label breakdowns share one scan and the grain is one."""
    frames = event_frames(events, CUR, PREV, BULK_MIN, PATTERNS, 20, 10, 20)
    scans = {name: final_nodes(df)["FileScan"] for name, df in frames.items()}
    assert scans["grain"] == scans["labels"] == 1 and sum(scans.values()) <= 6, scans
    assert not final_nodes(frames["labels"])["Expand"] and final_nodes(frames["labels"])["Exchange"] <= 2


def test_devices_of_a_render_are_ranked_without_a_window_over_all(events):
    frames = event_frames(events, CUR, PREV, BULK_MIN, PATTERNS, 20, 10, 20)
    derived = derived_frames(frames["grain"], frames["labels"], CUR, PREV, "all", "daily", BULK_MIN, PATTERNS, 10, ())
    tree = derived["devices"]._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in tree.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in line for line in windows)
