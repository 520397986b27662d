"""Bulk-order item detail: what large purchases contained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import MONEY, money, threshold
from tidemark.operators.kpi import BULK_MIN_REVENUE
from tidemark.operators.orders import PURCHASE
from tidemark.plans.periods import Period
from tidemark.plans.prepare import item_fields, prepare
from tidemark.sources.events import revenue_type, scan


def bulk_order_items(events: DataFrame, cur: Period, min_revenue: float = BULK_MIN_REVENUE,
                     k: int | None = 20) -> DataFrame:
    """Per item name over purchases with event revenue >= ``min_revenue`` in ``cur``.

    ``order_count`` distinct transactions, ``total_quantity``, ``item_revenue``
    (``sum(price * quantity)``; rows with a NULL factor are ignored).  Top ``k`` (``None``: all)
    by item revenue (NULL last, ties by name).  The revenue filter reaches the
    Parquet scan as a pushed filter on ``ecommerce.purchase_revenue``.
    """
    rev = F.col("ecommerce.purchase_revenue")
    src = scan(events, cur).where((F.col("event_name") == PURCHASE) & (rev >= threshold(min_revenue, revenue_type(events))))
    items = (prepare(src, "transaction_id", it=item_fields("item_name", "price", "quantity"))
             .select("transaction_id", F.explode("it").alias("it")))
    agg = items.groupBy(F.col("it.item_name").alias("product_name")).agg(
        F.count_distinct("transaction_id").alias("order_count"),
        F.sum("it.quantity").alias("total_quantity"),
        money(F.sum(F.col("it.price").cast(MONEY) * F.col("it.quantity"))).alias("item_revenue"),
    )
    ordered = agg.orderBy(F.col("item_revenue").desc_nulls_last(), F.col("product_name").asc_nulls_first())
    return ordered if k is None else ordered.limit(k)
