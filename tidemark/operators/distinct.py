"""Distinct users and sessions over long periods from small states per day.

Two kinds of state, both merged without the rows they came from:

* HLL sketches (``daily_sketches``): 2^``lg_k`` registers per day and figure.
  A count is off by a relative standard error of 0.8326 / sqrt(2^lg_k), which
  is 0.65 % for the default 14; three times that is exceeded about once in 400.
* Bitmaps of numbered users (``daily_user_bitmaps``), exact: a dictionary gives
  every user a number once, a day holds one bitmap of 32,768 users per range of
  numbers, and a period's users are the bits of the bitmaps merged by OR.  No
  row is expanded for a second distinct count, and the shuffle carries bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sessions import SESSION_KEY
from tidemark.plans.periods import Period, covering, period_type
from tidemark.plans.prepare import prepare
from tidemark.sources.days import hadoop_path
from tidemark.sources.events import scan

LG_K = 14
_COUNTS = ("users", "new_users", "sessions")
#: Users whose bits one bitmap holds.
BITMAP = 32_768


def relative_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a count from sketches of ``2 ** lg_k`` registers."""
    return 0.8326 / (1 << lg_k) ** 0.5


def _keys() -> dict[str, Column]:
    """What is counted distinct, over flat events."""
    user = F.col("user_pseudo_id")
    return {"users": user, "new_users": F.when(F.col("s_num") == 1, user), "sessions": F.concat(user, F.col("sid").cast("string"))}


def daily_sketches(events: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``event_date, users, new_users, sessions``: one sketch of each per day, built map-side."""
    flat = prepare(events, "event_date", *SESSION_KEY, "s_num")
    return flat.groupBy("event_date").agg(*[F.hll_sketch_agg(c, lg_k).alias(n) for n, c in _keys().items()])


def _of_type(days: DataFrame, cur: Period, prev: Period, gap_as_previous: bool) -> DataFrame:
    days = scan(days, covering(cur, prev)) if gap_as_previous else scan(days, cur, prev)
    return days.withColumn("type", period_type(cur))


def sketch_counts(sketches: DataFrame, cur: Period, prev: Period, gap_as_previous: bool = True) -> DataFrame:
    """``type, users, new_users, sessions`` of both periods from daily sketches, within ``relative_error``."""
    days = _of_type(sketches, cur, prev, gap_as_previous)
    return days.groupBy("type").agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in _COUNTS])


def extend_users(events: DataFrame, path: str) -> DataFrame:
    """Number the users of ``events`` that the dictionary at ``path`` does not have yet; the dictionary ``user_pseudo_id, user_number``.

    Numbers are given when the rows are written and never change: dense within
    a writing task, each call's after all earlier ones.
    """
    spark = events.sparkSession
    users = prepare(events, "user_pseudo_id").where(F.col("user_pseudo_id").isNotNull()).distinct()
    root, fs = hadoop_path(spark, path)
    start = 0
    if fs.exists(root):
        old = read_users(spark, path)
        users = users.join(old, "user_pseudo_id", "left_anti")
        last = old.agg(F.max("user_number")).first()[0]
        start = 0 if last is None else (last // BITMAP + 1) * BITMAP
    users = users.withColumn("user_number", F.lit(start) + F.monotonically_increasing_id())
    users.write.mode("append").parquet(path)
    return read_users(spark, path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_pseudo_id string, user_number long").parquet(path)


def daily_user_bitmaps(events: DataFrame, users: DataFrame) -> DataFrame:
    """``event_date, bucket, users, new_users``: bitmaps of each day's users and new users; ``users`` has all of them.

    Events shrink to one row per day and user before they meet the dictionary,
    so a user with a huge share of the events is a row a day.
    """
    flat = prepare(events, "event_date", "user_pseudo_id", "s_num").where(F.col("user_pseudo_id").isNotNull())
    seen = flat.groupBy("event_date", "user_pseudo_id").agg(F.bool_or(F.col("s_num") == 1).alias("is_new"))
    numbered = seen.join(users, "user_pseudo_id")
    bit = F.bitmap_bit_position("user_number")
    return numbered.groupBy("event_date", F.bitmap_bucket_number("user_number").alias("bucket")).agg(
        F.bitmap_construct_agg(bit).alias("users"), F.bitmap_construct_agg(F.when(F.col("is_new"), bit)).alias("new_users"))


def bitmap_counts(bitmaps: DataFrame, cur: Period, prev: Period, gap_as_previous: bool = True) -> DataFrame:
    """``type, users, new_users`` of both periods, exact: one merge of bitmaps, then their bits."""
    merged = _of_type(bitmaps, cur, prev, gap_as_previous).groupBy("type", "bucket").agg(
        F.bitmap_or_agg("users").alias("users"), F.bitmap_or_agg("new_users").alias("new_users"))
    return merged.groupBy("type").agg(*[F.sum(F.bitmap_count(c)).alias(c) for c in ("users", "new_users")])
