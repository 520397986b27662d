"""Build the nested events table from the driver's TPC-H-style test tables.

Mapping (see FIXTURES.md §3): one event per ``events`` row, joined to its order
(``o_orderkey = event_id``) for revenue and to customer → nation → region for
geography; purchase and item-view events carry the order's line items.  All
of it is joins, one ``groupBy`` and column expressions, so it scales with the
input tables.

The dimension joins are left to the planner: AQE turns them into broadcast
joins from the measured size of nation/region/customer and keeps sort-merge
joins when a side is large.  Line items are nested per order, only for orders
whose events show items; an order's line count is bounded by the source (at
most a few dozen lines), so each ``items`` array is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the test rig (FIXTURES.md §3): param/property constants.
SESSION_BUCKET_MICROS = 21_600_000_000  # 6 hours
STORE_SOURCE_VALUE = "QR_Store_247486"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _entry(key: str, string_value: Column | None = None, int_value: Column | None = None) -> Column:
    return F.struct(
        F.lit(key).alias("key"),
        F.struct(
            (string_value if string_value is not None else F.lit(None).cast("string")).alias("string_value"),
            (int_value if int_value is not None else F.lit(None).cast("bigint")).alias("int_value"),
        ).alias("value"),
    )


def _case(c: Column, mapping: dict[int, str | None]) -> Column:
    out = None
    for k, v in mapping.items():
        lit = F.lit(v).cast("string")
        out = F.when(c == k, lit) if out is None else out.when(c == k, lit)
    return out


def items_by_order(spark: SparkSession, sf_dir: str, order_ids: DataFrame) -> DataFrame:
    """``(l_orderkey, items)``: line items of each order in ``order_ids`` (one column) as a sorted item array.

    Lines of other orders go before they take their part's names and are nested.
    """
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    lines = lines.join(order_ids.toDF("_wanted"), F.col("l_orderkey") == F.col("_wanted"), "left_semi")
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    item = F.struct(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("item_category"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    return (lines.join(part, lines.l_partkey == part.p_partkey)
            .groupBy("l_orderkey")
            .agg(F.sort_array(F.collect_list(item)).alias("items")))


def build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested GA4-style events (``EVENTS_SCHEMA`` column order) derived from ``sf_dir``."""
    ev = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    cust_geo = (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
                .join(region, nation.n_regionkey == region.r_regionkey)
                .select("c_custkey", "n_name", "r_name"))
    base = (ev.join(orders, ev.event_id == orders.o_orderkey)
            .join(cust_geo, orders.o_custkey == cust_geo.c_custkey))
    eid, uid, etype = F.col("event_id"), F.col("user_id"), F.col("event_type")
    has_items = etype.isin("purchase", "view")
    items = items_by_order(spark, sf_dir, ev.where(has_items).select("event_id"))
    with_items = base.join(items, base.event_id == F.col("l_orderkey"), "left")

    micros_sql = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    micros = F.expr(micros_sql)
    is_purchase = etype == "purchase"
    event_name = (F.when(etype == "signup", "sign_up").when(etype == "view", "view_item")
                  .when(etype == "error", "page_view").otherwise(etype))

    params = F.array(
        F.when(eid % 17 != 0, _entry("ga_session_id", int_value=F.expr(f"{micros_sql} div {SESSION_BUCKET_MICROS}"))),
        _entry("ga_session_number", int_value=(F.lit(1) + uid % 3).cast("bigint")),
        _entry("source", string_value=_case(eid % 4, {0: STORE_SOURCE_VALUE, 1: "google", 2: None, 3: ""})),
        F.when(eid % 6 == 0, _entry("gender", string_value=F.lit("M"))),
        F.when(eid % 7 == 0, _entry("age", string_value=F.lit(""))),
    )
    props = F.array(
        F.when(uid % 4 != 3, _entry("u_gender", string_value=_case(uid % 4, {0: "female", 1: "male", 2: "2"}))),
        F.when(uid % 3 != 2, _entry("age_group", string_value=_case(uid % 3, {0: "20-29", 1: "30-39"}))),
    )
    not_null = lambda x: x.isNotNull()
    empty_items = F.array().cast("array<struct<item_id:string,item_name:string,item_category:string,"
                                 "price:decimal(18,2),quantity:bigint>>")

    return with_items.select(
        micros.alias("event_timestamp"),
        F.concat(F.lit("u"), uid.cast("string")).alias("user_pseudo_id"),
        event_name.alias("event_name"),
        F.struct(
            F.when(is_purchase & (eid % 29 != 0), F.concat(F.lit("T"), F.expr("event_id div 2").cast("string")))
            .alias("transaction_id"),
            F.when(is_purchase & (eid % 23 != 0), F.col("o_totalprice").cast("decimal(18,2)")).alias("purchase_revenue"),
        ).alias("ecommerce"),
        F.filter(params, not_null).alias("event_params"),
        F.filter(props, not_null).alias("user_properties"),
        F.when(has_items, F.coalesce(F.col("items"), empty_items)).otherwise(empty_items).alias("items"),
        F.struct(
            _case(uid % 4, {0: "Naver", 1: " ", 2: "google"}).alias("source"),
            _case(uid % 5, {0: "organic", 1: "CPC", 2: "", 3: "referral"}).alias("medium"),
        ).alias("traffic_source"),
        F.struct(
            F.when(eid % 31 != 0, F.col("r_name")).alias("country"),
            F.col("n_name").alias("city"),
        ).alias("geo"),
        F.struct(_case(eid % 4, {0: "desktop", 1: "mobile", 2: "tablet"}).alias("category")).alias("device"),
        F.date_format("ts", "yyyyMMdd").alias("event_date"),
    )
