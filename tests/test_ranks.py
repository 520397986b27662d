"""Positions in frames of any size: counted by buckets, never by a window over the whole frame."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import change_alerts, revenue_share
from tidemark.operators import ranks
from tidemark.testing.params import THRESHOLDS


def frame(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(f"{'Unknown' if i % 3 == 0 else 'L'} {i}", float(rng.choice([0, 0, 0, 5, 7.25, rng.random() * 1e6, -3]))) for i in range(n)]
    rows += [(None, None), ("none", None), (None, 2.0)]
    return spark.createDataFrame(rows, "label string, current_revenue double").repartition(7), rows


def order(r):
    return (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or "")


@pytest.mark.parametrize("n,sample,step", [(0, 1600, 8), (5, 1600, 8), (3000, 40, 2), (3000, 1600, 8), (3000, 1, 1)])
def test_positions_of_all_rows(spark, monkeypatch, n, sample, step):
    monkeypatch.setattr(ranks, "SAMPLE", sample)
    monkeypatch.setattr(ranks, "STEP", step)
    df, rows = frame(spark, n)
    got = revenue_share(df, "label", uncut=True).collect()
    assert [(r.label, r.current_revenue) for r in got] == sorted(rows, key=order)
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    shares = {r.label: r.revenue_share for r in revenue_share(df, "label").collect()}
    assert all(shares[r.label] == r.revenue_share for r in got if r.label)


def test_an_empty_frame(spark):
    assert revenue_share(frame(spark, 0)[0].limit(0), "label", uncut=True).collect() == []


def test_no_window_over_the_whole_frame(spark):
    df, _ = frame(spark, 3000)
    tree = revenue_share(df, "label", uncut=True)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in tree.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in line for line in windows)


def test_first_known_rows_keep_their_positions(spark):
    df, rows = frame(spark, 2000)
    key = ranks.by_value(F.col("current_revenue"), F.col("label"))
    got = ranks.ranks_of_first(df, key, F.coalesce(~F.col("label").startswith("Unknown"), F.lit(True)), 5).orderBy("rank").collect()
    placed = [(i + 1, r) for i, r in enumerate(sorted(rows, key=order)) if not (r[0] or "").startswith("Unknown")][:5]
    assert [(r["rank"], (r.label, r.current_revenue)) for r in got] == placed


def test_alerts_of_uncut_demographics(spark):
    rng = random.Random(5)
    summary = spark.createDataFrame([("Current", 10.0, 1.0, 5, 9), ("Previous", 10.0, 1.0, 5, 9)],
                                    "type string, revenue double, bulk_revenue double, orders long, sessions long")
    rows = [(f"{rng.choice(['Male', 'Unknown', 'Female'])} / {i}", float(rng.randrange(10**8)), float(rng.randrange(-10**8, 10**8)), None,
             rng.randrange(-200, 200), 1.5) for i in range(900)]
    demo = spark.createDataFrame(rows, "demographic string, current_revenue double, revenue_change double, revenue_change_pct double, "
                                       "sessions_change long, sessions_change_pct double").repartition(5)
    cut, uncut = (change_alerts(summary, demographics=demo, thresholds=THRESHOLDS, uncut=u) for u in (False, True))
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, uncut.collect()), key=str) and uncut.count() == 6
