import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dates import grain_start, to_yyyymmdd, week_start_sunday
from tidemark.functions.params import param_int, param_str
from tidemark.functions.arith import pct_change, share_pct
from tidemark.plans.periods import Period, covering, period_type
from tidemark.testing.frames import event, events_frame


def test_param_lookup_first_in_array_order(spark):
    rows = [event(sid=None, s_num=None, params=[("gender", "F", None), ("u_gender", "m", None),
                                                 ("gender", "x", None)]),
            event(sid=7, s_num=None, params=[("ga_session_id", None, 99)]),
            event(sid=None, s_num=None)]
    df = events_frame(spark, rows)
    out = df.select(param_str("event_params", ("u_gender", "gender")).alias("g"),
                    param_str("event_params", "gender").alias("g1"),
                    param_int("event_params", "ga_session_id").alias("sid"),
                    param_str("user_properties", "age").alias("miss")).collect()
    # first entry in array order whose key is in the list, not list priority
    assert [r.g for r in out] == ["F", None, None]
    assert [r.g1 for r in out] == ["F", None, None]
    assert [r.sid for r in out] == [None, 7, None]  # duplicate keys: first wins
    assert all(r.miss is None for r in out)


def test_param_lookup_null_array(spark):
    df = spark.createDataFrame([(None,)], "event_params array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>")
    assert df.select(param_int("event_params", "ga_session_id").alias("x")).first().x is None


def test_week_starts_on_sunday(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 13),), (dt.date(2024, 1, 14),), (dt.date(2024, 1, 15),)], "d date")
    got = [r.w for r in df.select(week_start_sunday(F.col("d")).alias("w")).collect()]
    assert got == [dt.date(2024, 1, 7), dt.date(2024, 1, 14), dt.date(2024, 1, 14)]


def test_unknown_grain_raises():
    with pytest.raises(ValueError):
        grain_start(F.col("d"), "일별")


def test_period_normalisation_and_covering():
    assert to_yyyymmdd(dt.date(2024, 1, 5)) == "20240105"
    assert to_yyyymmdd("2024-01-05") == "20240105"
    c, p = Period("2024-01-16", "20240130"), Period(dt.date(2024, 1, 1), "20240114")
    assert covering(c, p) == Period("20240101", "20240130")
    with pytest.raises(ValueError):
        Period("20240102", "20240101")


def test_gap_day_is_previous(spark):
    df = spark.createDataFrame([("20240115",), ("20240116",), ("20240101",)], "event_date string")
    got = [r.t for r in df.select(period_type(Period("20240116", "20240130")).alias("t")).collect()]
    assert got == ["Previous", "Current", "Previous"]


def test_pct_and_share_rounding(spark):
    df = spark.createDataFrame([(1, 8), (3, 0), (-1, 8), (1, 3)], "c bigint, p bigint")
    got = df.select(pct_change(F.col("c"), F.col("p")).alias("x"), share_pct(F.col("c"), F.col("p")).alias("s")).collect()
    assert [r.x for r in got] == [-87.5, None, -112.5, -66.7]  # half away from zero, NULL on /0
    assert [r.s for r in got] == [12.5, 0.0, -12.5, 33.3]
