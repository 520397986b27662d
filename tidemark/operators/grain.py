"""The daily grain: mergeable partial figures from which any pair of periods is answered without the events.

One row per (date, user, session, source of the event, transaction) with
sums, flags and the earliest time.  Every measure merges: sums add up, flags
combine by OR / AND, times by their minimum; distinct users, sessions and
orders are rows of a coarser grouping.  The table is partitioned by date, so a
day that was corrected is computed again alone (``refresh_grain``), and a
summary or trend of any periods reads only their days of a table that is much
narrower and shorter than the events.

The bulk threshold and the repair patterns are part of the measures; they are
kept in the table's schema and a table never mixes two of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.arith import MONEY, threshold
from tidemark.operators.orders import PURCHASE, RepairPatterns, purchase_item_flags
from tidemark.operators.sessions import SESSION_KEY, source_of_event
from tidemark.plans.periods import Period
from tidemark.plans.prepare import item_fields, prepare
from tidemark.sources.days import PARTITIONS, day_folders, hadoop_path, put_days
from tidemark.sources.events import scan

SIGN_UP = "sign_up"
# Fixed value: event-level purchase revenue at or above which an order is "bulk".
BULK_MIN_REVENUE = 1_500_000

GRAIN_KEY = ["event_date", *SESSION_KEY, "_src", "transaction_id"]
#: How each measure of the grain merges.
_MERGE = {"is_new": F.bool_or, "_t": F.min, "n_events": F.sum, "signups": F.sum, "revenue": F.sum, "p_any": F.bool_or,
          "p_rev": F.sum, "p_null_rev": F.sum, "b_any": F.bool_or, "b_rev": F.sum, "no_false": F.bool_and,
          "any_true": F.bool_or}
SESSION_MEASURES = ("is_new",)
COMMERCE_MEASURES = ("n_events", "signups", "revenue", "p_any", "p_rev", "p_null_rev", "b_any", "b_rev", "no_false", "any_true")
#: Columns of the events that the measures need, and the items' fields.
SESSION_INPUTS = ("s_num",)
COMMERCE_INPUTS = ("event_name", "purchase_revenue")


def item_inputs() -> Column:
    return item_fields("item_name", "item_category")


def event_measures(bulk_min: float, patterns: RepairPatterns) -> dict[str, Column]:
    """Aggregates over events for every measure."""
    is_purchase, rev = F.col("event_name") == PURCHASE, F.col("purchase_revenue")
    is_bulk = is_purchase & (rev >= threshold(bulk_min, MONEY))
    no_false, any_true = purchase_item_flags(patterns)
    return {
        "is_new": F.bool_or(F.col("s_num") == 1),
        "_t": F.min("event_timestamp"),
        "n_events": F.count(F.lit(1)),
        "signups": F.count_if(F.col("event_name") == SIGN_UP),
        "revenue": F.sum(F.coalesce(rev, F.lit(0))),
        "p_any": F.bool_or(is_purchase),
        "p_rev": F.sum(F.when(is_purchase, rev)),
        "p_null_rev": F.count_if(is_purchase & rev.isNull()),
        "b_any": F.bool_or(is_bulk),
        "b_rev": F.sum(F.when(is_bulk, rev).otherwise(F.lit(0))),
        "no_false": F.bool_and(no_false),
        "any_true": F.bool_or(any_true),
    }


def merged_measures(names: Iterable[str]) -> list[Column]:
    """Aggregates over grain rows for the named measures."""
    return [_MERGE[n](n).alias(n) for n in names]


def _rules(bulk_min: float, patterns: RepairPatterns) -> dict[str, str]:
    return {"bulk_min": str(bulk_min), "patterns": repr(patterns)}


def accounting() -> dict[str, Column]:
    """Events read, and those that some figure leaves out, as aggregates over the grain's input rows."""
    bought = F.col("event_name") == PURCHASE
    return {"events": F.count(F.lit(1)), "without_user": F.count_if(F.col("user_pseudo_id").isNull()),
            "without_session": F.count_if(F.col("sid").isNull()),
            "purchases_without_transaction": F.count_if(bought & F.col("transaction_id").isNull()),
            "purchases_without_revenue": F.count_if(bought & F.col("purchase_revenue").isNull()),
            "purchases_without_items": F.count_if(bought & (F.coalesce(F.size("items"), F.lit(0)) <= 0))}


def daily_grain(events: DataFrame, bulk_min: float = BULK_MIN_REVENUE, patterns: RepairPatterns = RepairPatterns(),
                counted: Observation | None = None) -> DataFrame:
    """The grain of all days of ``events``; one scan, one hash aggregate with map-side combine.

    ``counted`` takes the figures of ``accounting`` in the same job that runs the grain.
    """
    cols = dict.fromkeys([*GRAIN_KEY[:3], "transaction_id", "event_timestamp", "param_source", "ts_source",
                          *SESSION_INPUTS, *COMMERCE_INPUTS])
    flat = prepare(events, *cols, items=item_inputs()).withColumn("_src", source_of_event())
    if counted is not None:
        flat = flat.observe(counted, *[c.alias(n) for n, c in accounting().items()])
    measures = event_measures(bulk_min, patterns)
    return (flat.groupBy(*GRAIN_KEY).agg(*[c.alias(n) for n, c in measures.items()])
            .withMetadata("b_rev", {"grain": _rules(bulk_min, patterns)}))


def _rules_of(grain: DataFrame) -> dict[str, str] | None:
    return grain.schema["b_rev"].metadata.get("grain")


def check_rules(grain: DataFrame, bulk_min: float, patterns: RepairPatterns) -> None:
    """A grain answers only for the threshold and patterns it was made with."""
    if (have := _rules_of(grain)) and have != _rules(bulk_min, patterns):
        raise ValueError(f"the grain was made with {have}")


def refresh_grain(events: DataFrame, path: str, period: Period, bulk_min: float = BULK_MIN_REVENUE,
                  patterns: RepairPatterns = RepairPatterns()) -> None:
    """Compute the grain of the period's days and put it in place of theirs in the table at ``path``.

    The days are written beside the table first, each then takes its place
    whole; a day of the period without events leaves the table.
    """
    spark = events.sparkSession
    grain = daily_grain(scan(events, period), bulk_min, patterns)
    root, fs = hadoop_path(spark, path)
    if fs.exists(root) and day_folders(spark, path):
        check_rules(read_grain(spark, path), bulk_min, patterns)
    staged = f"{path}/_writing-{uuid.uuid4().hex}"
    try:
        (grain.hint("rebalance", "event_date").sortWithinPartitions("event_date", *SESSION_KEY)
         .write.partitionBy("event_date").parquet(staged))
        put_days(spark, staged, path, PARTITIONS, overwrite=True, period=period)
    finally:
        p, fs = hadoop_path(spark, staged)
        fs.delete(p, True)


def read_grain(spark: SparkSession, path: str, period: Period | None = None) -> DataFrame:
    """The grain table at ``path``; with ``period``, only its days are listed."""
    folders = list(day_folders(spark, path, period=period).values())
    every = list(day_folders(spark, path).values())
    if not every:
        raise FileNotFoundError(f"{path} has no day of a grain")
    schema = spark.read.option("basePath", path).parquet(every[-1]).schema
    for f in schema.fields:
        if f.name == "event_date":
            f.dataType = spark.createDataFrame([], "d string").schema["d"].dataType
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema)
