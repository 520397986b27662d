"""Sketches, bitmaps, salted sessions, bucketed tables and the render's accounting."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import (
    Period, bitmap_counts, daily_sketches, daily_user_bitmaps, dashboard, extend_users, kpi_summary, session_channels,
    session_first_source, sketch_counts, trend, write_bucketed)
from tidemark.operators import distinct
from tidemark.operators.kpi import APPROX_ERROR, _selected
from tidemark.session import scratch_folder
from tidemark.sources import events as event_tables
from tidemark.sources.fixtures import build_events
from tidemark.testing.frames import event, events_frame
from tidemark.testing.params import BULK_MIN, CUR, PATTERNS, PREV, SF_SMALL

DAY = Period("20240110", "20240110"), Period("20240109", "20240109")


@pytest.fixture(scope="module")
def events(spark):
    return build_events(spark, SF_SMALL)


def many_users(spark, n=30_000):
    """Two days with ``n`` users each, a third of them on both, some events without a user."""
    empty = events_frame(spark, [event("20240110")])
    rows = spark.range(2 * n).selectExpr(
        f"IF(id < {n}, '20240109', '20240110') AS event_date", f"'u' || IF(id < {n}, id, id - {n} + {2 * n // 3}) AS user", "id % 3 AS s_num")
    rows = rows.withColumn("user", F.when(F.rand(3) > 0.01, F.col("user")))
    one = empty.drop("event_date", "user_pseudo_id")
    return rows.join(F.broadcast(one)).withColumnRenamed("user", "user_pseudo_id").withColumn(
        "event_params", F.array(F.struct(F.lit("ga_session_id").alias("key"), F.struct(
            F.lit(None).cast("string").alias("string_value"), F.lit(1).cast("long").alias("int_value")).alias("value")),
            F.struct(F.lit("ga_session_number").alias("key"), F.struct(
                F.lit(None).cast("string").alias("string_value"), F.col("s_num").alias("int_value")).alias("value")))).drop("s_num")


@pytest.fixture(scope="module")
def large(spark):
    path = scratch_folder(spark, "test-users")
    many_users(spark).write.parquet(path)
    return spark.read.parquet(path).withColumn("event_date", F.col("event_date").cast("string"))


def counts(df, *names):
    return {r.type: tuple(r[n] for n in names) for r in df.collect()}


def test_sketches_are_within_their_stated_error(large):
    names = ("users", "new_users", "sessions")
    exact = counts(kpi_summary(large, *DAY), *names)
    for lg_k in (12, 14):
        got = counts(sketch_counts(daily_sketches(large, lg_k), *DAY), *names)
        for kind, row in exact.items():
            assert all(abs(a - b) <= 4 * distinct.relative_error(lg_k) * b for a, b in zip(got[kind], row)), (lg_k, got, exact)
    got = counts(kpi_summary(large, *DAY, approx=True), *names)
    assert all(abs(a - b) <= 4 * APPROX_ERROR * b for k in exact for a, b in zip(got[k], exact[k])) and got != exact


def test_approx_needs_no_session_grain_and_leaves_other_figures_alone(events):
    names = ("signups", "orders", "revenue", "bulk_orders", "bulk_revenue", "filtered_orders", "filtered_revenue")
    for mode in ("all", "online"):
        args = (events, CUR, PREV, mode, BULK_MIN, PATTERNS)
        assert counts(kpi_summary(*args, approx=True), *names) == counts(kpi_summary(*args), *names)
    plan = kpi_summary(events, CUR, PREV, "all", BULK_MIN, PATTERNS, approx=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "approx_count_distinct" in plan


def test_days_merge_to_any_period(events):
    """Over both periods together a user of two days counts once."""
    one, none = Period("20240101", "20240130"), Period("20230101", "20230101")
    got = counts(sketch_counts(daily_sketches(events), one, none), "users", "sessions")
    exact = counts(kpi_summary(events, one, none), "users", "sessions")
    assert all(abs(a - b) <= 1 + 0.03 * b for a, b in zip(got["Current"], exact["Current"]))


def test_bitmaps_are_exact_and_merged_once(spark, large, events):
    for ev in (large, events):
        path = scratch_folder(spark, "test-dictionary")
        extend_users(ev.where("event_date < '20240110'"), path)
        first = {r.user_pseudo_id: r.user_number for r in spark.read.parquet(path).collect()}
        users = extend_users(ev, path)
        numbers = {r.user_pseudo_id: r.user_number for r in users.collect()}
        assert len(set(numbers.values())) == len(numbers) == users.count() and first.items() <= numbers.items()
        assert extend_users(ev, path).count() == len(numbers)
        bitmaps = daily_user_bitmaps(ev, users)
        for periods in (DAY, (CUR, PREV), (Period("20240101", "20240105"), Period("20240103", "20240112"))):
            for gap in (True, False):
                exact = counts(kpi_summary(ev, *periods, gap_as_previous=gap), "users", "new_users")
                got = counts(bitmap_counts(bitmaps, *periods, gap_as_previous=gap), "users", "new_users")
                assert got == exact
    plan = bitmap_counts(bitmaps, CUR, PREV)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bitmap_or_agg(users") == 1 and "Expand" not in plan


def test_no_events_no_users(spark, events):
    path = scratch_folder(spark, "test-dictionary")
    users = extend_users(events.limit(0), path)
    assert users.count() == 0 and bitmap_counts(daily_user_bitmaps(events.limit(0), users), CUR, PREV).count() == 0
    assert extend_users(events, path).count() == events.select("user_pseudo_id").distinct().count()


@pytest.mark.parametrize("mode", ["store", "online"])
def test_a_session_with_most_transactions_is_dealt_out(spark, mode):
    rows = [event("20240110", 50 + i, name="purchase", tx=f"t{i}", rev=1, source="qr_store_" if i else None, ts_source="x") for i in range(1500)]
    rows += [event("20240109" if i % 2 else "20240110", i, user=f"u{i % 90}", sid=i % 4, source=["qr_store_", "web", None][i % 3], name="purchase",
                   tx=f"o{i}", rev=2) for i in range(600)]
    rows += [event("20240109", 3, source="qr_store_"), event("20240110", 1, user=None), event("20240110", 1, sid=None)]
    ev = events_frame(spark, rows)
    plain, salted = (sorted(map(tuple, kpi_summary(ev, *DAY, mode, session_salts=s).collect())) for s in (1, 16))
    assert plain == salted and plain
    grain = spark.createDataFrame([("b", "u", 1, f"s{i}", f"t{i}", i) for i in range(5000)], "bucket string, user_pseudo_id string, sid int, "
                                  "_src string, transaction_id string, _t int")
    kept = _selected(grain, "store", ["s0"], 16)
    assert kept.count() == 5000 and _selected(grain, "online", ["s0"], 16).count() == 0
    windows = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert windows and all("_part" in x for x in windows)  # it sees one row per part of a session


def test_bucketed_sessions_need_no_exchange(spark, events):
    name = f"events_{uuid.uuid4().hex[:8]}"
    write_bucketed(events, name, scratch_folder(spark, "test-bucketed"), 4)
    table = spark.table(name)
    for figure in (lambda e: session_first_source(e, CUR), lambda e: session_channels(e, CUR)):
        df = figure(table)
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, figure(events).collect()), key=str)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(event_date" in plan
    assert sorted(map(tuple, trend(table, CUR).collect())) == sorted(map(tuple, trend(events, CUR).collect()))
    spark.sql(f"DROP TABLE {name}")


def test_a_larger_table_gets_more_buckets(spark, events, monkeypatch):
    """A bucket is read by one task: its events are bounded, not their number."""
    monkeypatch.setattr(event_tables, "ROWS_PER_BUCKET", 200)
    odd = events.unionByName(events.limit(50).withColumn("user_pseudo_id", F.lit(None).cast("string")))
    odd = spark.createDataFrame(odd.collect(), odd.schema)
    name, path = f"events_{uuid.uuid4().hex[:8]}", scratch_folder(spark, "test-bucketed")
    write_bucketed(odd, name, path, 2)
    n = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
    assert n > 2 and n % 2 == 0 and 200 * (n - 2) < odd.count() <= 200 * n
    df = session_first_source(spark.table(name))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, session_first_source(odd).collect()), key=str)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    write_bucketed(odd, name, path, 2, mode="append")
    monkeypatch.setattr(event_tables, "ROWS_PER_BUCKET", 1 << 20)
    write_bucketed(odd.limit(1), name, path, 2, mode="append")
    assert spark.table(name).count() == 2 * odd.count() + 1
    spark.sql(f"DROP TABLE {name}")


def test_the_render_counts_what_it_leaves_out(spark):
    rows = [event("20240110", 1, user=None), event("20240110", 2, sid=None), event("20240109", 3, name="purchase", tx=None, rev=4),
            event("20240110", 4, name="purchase", tx="a", rev=None, items=[("p", "n", "c", 1, 1)]), event("20240115", 5, user=None)]
    shown = dashboard(events_frame(spark, rows), *DAY)
    assert shown.accounting == {"events": 4, "without_user": 1, "without_session": 1, "purchases_without_transaction": 1,
                                "purchases_without_revenue": 1, "purchases_without_items": 1}
    shown.close()
    assert dashboard(events_frame(spark, rows), *DAY, materialize=False).accounting is None
