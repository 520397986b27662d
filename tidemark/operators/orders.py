"""Order classification: repair-only orders and null-aware NOT IN membership."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.periods import Period
from tidemark.plans.prepare import prepare
from tidemark.sources.events import scan

PURCHASE = "purchase"


@dataclass(frozen=True)
class RepairPatterns:
    """An item is a repair item when the upper-cased category or name matches
    ``upper_pattern`` or the raw name matches ``name_pattern`` (case-sensitive)."""

    # Default patterns of the analytics being rebuilt.
    upper_pattern: str = "EASY.REPAIR"
    name_pattern: str = "pad|headrest|cover|leg|wheel|glide|block|seat|easy.repair"


def item_is_repair(item: Column, patterns: RepairPatterns) -> Column:
    """Three-valued: NULL when only the raw-name test could decide and the name is NULL."""
    return (F.upper(F.coalesce(item["item_category"], F.lit(""))).rlike(patterns.upper_pattern)
            | F.upper(F.coalesce(item["item_name"], F.lit(""))).rlike(patterns.upper_pattern)
            | item["item_name"].rlike(patterns.name_pattern))


def purchase_item_flags(patterns: RepairPatterns, items: str = "items",
                        event_name: str = "event_name") -> tuple[Column, Column]:
    """Per event, ``(no_false, any_true)`` over its items' repair predicate.

    Both are NULL for events that are not purchases or have no items, so they
    drop out of ``bool_and``/``bool_or``.  Over a transaction,
    ``bool_and(no_false) AND bool_or(any_true)`` equals LOGICAL_AND of the
    predicate over all its items with NULL predicates ignored (NULL when no
    item decides), without exploding the arrays.
    """
    # Zip only the two fields the predicate reads, so the scan prunes the others.
    arr = F.arrays_zip(F.col(f"{items}.item_name").alias("item_name"),
                       F.col(f"{items}.item_category").alias("item_category"))
    relevant = (F.col(event_name) == PURCHASE) & F.coalesce(F.size(F.col(f"{items}.item_name")) > 0, F.lit(False))
    no_false = F.forall(arr, lambda x: F.coalesce(item_is_repair(x, patterns), F.lit(True)))
    any_true = F.exists(arr, lambda x: F.coalesce(item_is_repair(x, patterns), F.lit(False)))
    return F.when(relevant, no_false), F.when(relevant, any_true)


def repair_only_flag(no_false: Column, any_true: Column) -> Column:
    return F.bool_and(no_false) & F.bool_or(any_true)


def repair_only_orders(events: DataFrame, period: Period | None = None,
                       patterns: RepairPatterns = RepairPatterns()) -> DataFrame:
    """``transaction_id`` of purchase orders whose every decided item is a repair item.

    One ``groupBy(transaction_id)`` over boolean flags: hash aggregation with
    map-side partial aggregation, so a transaction repeated in many events is
    combined before the shuffle.  A NULL transaction id forms its own group.
    """
    src = scan(events, period) if period else events
    no_false, any_true = purchase_item_flags(patterns)
    flagged = prepare(src, "transaction_id", "event_name", "items").where(F.col("event_name") == PURCHASE)
    return (flagged.groupBy("transaction_id")
            .agg(repair_only_flag(no_false, any_true).alias("repair_only"))
            .where(F.col("repair_only"))
            .select("transaction_id"))


def not_in_null_aware(left: DataFrame, left_col: str, right: DataFrame, right_col: str,
                      out: str = "not_in") -> DataFrame:
    """Add boolean ``out`` = ``left_col NOT IN (SELECT right_col FROM right)``, NULL counted as false.

    SQL semantics: an empty set keeps every row (NULL keys too); otherwise a
    NULL key, a key in the set, or any NULL in the set gives not-kept.  Planned
    as an equi left join on the distinct set keys (shuffle or broadcast by
    measured size, never a nested-loop existence join) plus one scalar
    subquery over the same distinct keys (set size, set has NULL).  NULL keys
    of ``left`` match nothing; a salt spreads them over all partitions.
    """
    keys = right.select(F.col(right_col).alias("_nin_key")).distinct()
    facts = keys.select(F.struct(F.count(F.lit(1)).alias("n"),
                                 F.coalesce(F.bool_or(F.col("_nin_key").isNull()), F.lit(False)).alias("null"))).scalar()
    hits = keys.select("_nin_key", F.lit(0).alias("_nin_hit"))
    salt = F.when(F.col(left_col).isNull(), F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(997))).otherwise(0)
    salted = left.withColumn("_nin_salt", salt.cast("int")).withColumn("_nin_facts", facts)
    joined = salted.join(hits, (salted[left_col] == hits["_nin_key"]) & (salted["_nin_salt"] == hits["_nin_hit"]), "left")
    keep = ((F.col("_nin_facts.n") == 0)
            | (F.col(left_col).isNotNull() & ~F.col("_nin_facts.null") & F.col("_nin_hit").isNull()))
    return joined.withColumn(out, keep).drop("_nin_key", "_nin_hit", "_nin_salt", "_nin_facts")
