"""Ranks over frames of any size, without a window over the whole frame.

Rows are dealt into buckets by split points taken from the frame itself: a
sample by hash (its rate follows the row count, so about ``SAMPLE`` rows) is
sorted, and every ``STEP``-th key is a split.  A row's rank is the number of
rows in the buckets before its own, from one count per bucket, plus its number
inside its bucket.  Split points and counts are uncorrelated scalar subqueries,
so the result stays one lazy plan; the frame is read once for each of them,
which is cheap for a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows sampled for split points (about), and sampled rows between two splits.
SAMPLE, STEP = 1600, 8


def by_value(value: Column, label: Column) -> Column:
    """A key that sorts ascending as: value descending with NULLs last, then label ascending with NULLs first."""
    return F.struct(value.isNull().alias("a"), (-value).alias("b"), label.isNotNull().alias("c"), label.alias("d"))


def with_rank(frame: DataFrame, key: Column, out: str = "rank") -> DataFrame:
    """``frame`` with the 1-based position of each row in the ascending order of ``key``."""
    keyed = frame.withColumn("_key", key)
    rows = F.greatest(keyed.select(F.count(F.lit(1))).scalar(), F.lit(1))
    sample = keyed.where(F.pmod(F.xxhash64("_key"), rows) < SAMPLE)
    splits = sample.select(F.filter(F.array_sort(F.collect_set("_key")), lambda _, i: i % STEP == STEP - 1)).scalar()
    dealt = (keyed.withColumn("_splits", splits)
             .withColumn("_bucket", F.size(F.filter("_splits", lambda s: s <= F.col("_key")))).drop("_splits"))
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.collect_list(F.struct("_bucket", "n"))).scalar()
    before = F.aggregate(F.filter("_counts", lambda c: c["_bucket"] < F.col("_bucket")), F.lit(0).cast("bigint"),
                         lambda total, c: total + c["n"])
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key"))
    return (dealt.withColumn("_in", inside).withColumn("_counts", counts)
            .withColumn(out, (before + F.col("_in")).cast("int")).drop("_key", "_bucket", "_in", "_counts"))


def ranks_of_first(frame: DataFrame, key: Column, keep: Column, n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows that ``keep`` holds for, with their positions among all rows of ``frame``.

    The rows are a top-n; the rows left out before each of them are counted in
    one aggregate.
    """
    keyed = frame.withColumn("_key", key)
    first = keyed.where(keep).orderBy("_key").limit(n)
    keys = first.select(F.array_sort(F.collect_list("_key"))).scalar()
    skipped = keyed.where(~keep).withColumn("_keys", keys)
    skipped = skipped.select(F.array(*[F.count_if(F.col("_key") < F.get("_keys", F.lit(i))) for i in range(n)])).scalar()
    return (first.withColumn("_in", F.row_number().over(Window.orderBy("_key"))).withColumn("_skipped", skipped)
            .withColumn(out, (F.col("_in") + F.get("_skipped", F.col("_in") - 1)).cast("int"))
            .drop("_key", "_in", "_skipped"))
