"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query derives the nested events table from the driver's tables in
``sf_dir`` and runs the operator over all of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import alerts, breakdowns, bulk, distinct, kpi, orders, sessions
from tidemark.plans.periods import covering
from tidemark.functions.dates import GRAINS, grain_start, parse_yyyymmdd
from tidemark.plans.prepare import item_fields, prepare
from tidemark.operators.dashboard import dashboard
from tidemark.operators.grain import read_grain, refresh_grain
from tidemark.session import scratch_folder
from tidemark.sources.events import read_events, scan, write_bucketed, write_events, write_shards
from tidemark.sources.fixtures import build_events
from tidemark.testing.params import BULK_MIN, CHANGED, CUR, PATTERNS, PREV, THRESHOLDS

Query = Callable[[SparkSession, str], DataFrame]


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_events(spark, sf_dir)


def _summary(ev: DataFrame, source: str = "all") -> DataFrame:
    return kpi.kpi_summary(ev, CUR, PREV, source, BULK_MIN, PATTERNS)


def _q_double_money(spark: SparkSession, d: str) -> DataFrame:
    """Bulk items of events whose money is DOUBLE, as real exports have it."""
    ev = _ev(spark, d)
    ev = (ev.withColumn("ecommerce", F.col("ecommerce").withField(
              "purchase_revenue", F.col("ecommerce.purchase_revenue").cast("double")))
          .withColumn("items", F.transform("items", lambda x: x.withField("price", x["price"].cast("double")))))
    return bulk.bulk_order_items(ev, CUR, float(BULK_MIN))


def _changing_days(ev: DataFrame) -> list[DataFrame]:
    """The events in three runs of days: DOUBLE money and no city, as they are, then wider money and narrow counts."""
    def money(df: DataFrame, kind: str) -> DataFrame:
        return (df.withColumn("ecommerce", F.col("ecommerce").withField(
                    "purchase_revenue", F.col("ecommerce.purchase_revenue").cast(kind)))
                .withColumn("items", F.transform("items", lambda x: x.withField("price", x["price"].cast(kind)))))

    day = F.col("event_date")
    early = money(ev.where(day < CHANGED[0]), "double").withColumn("geo", F.col("geo").dropFields("city"))
    late = money(ev.where(day >= CHANGED[1]), "decimal(20,3)")
    late = late.withColumn("items", F.transform("items", lambda x: x.withField("quantity", x["quantity"].cast("int"))))
    return [early, ev.where((day >= CHANGED[0]) & (day < CHANGED[1])), late]


def _q_changing_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Locations over a table whose days differ in types and columns, written and read again."""
    path = scratch_folder(spark, "changing-events")
    for part in _changing_days(_ev(spark, d)):
        write_events(part, path, mode="append")
    return breakdowns.geo_performance(read_events(spark, path, covering(CUR, PREV)), CUR, PREV)


def _q_shards(spark: SparkSession, d: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An operator over one table a day, whose days differ, written and read again."""
    path = scratch_folder(spark, "event-shards")
    for part in _changing_days(_ev(spark, d)):
        write_shards(part, path)
    return operator(read_events(spark, path, covering(CUR, PREV), layout="shards"))


def _q_grain(spark: SparkSession, d: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An answer from the daily grain, written and read again; a part of its days is computed twice."""
    ev, path = _ev(spark, d), scratch_folder(spark, "grain")
    for period in (covering(CUR, PREV), CUR):
        refresh_grain(ev, path, period, BULK_MIN, PATTERNS)
    return answer(read_grain(spark, path))


def _q_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Users and new users from daily bitmaps; the dictionary is made in two steps."""
    ev, path = _ev(spark, d), scratch_folder(spark, "users")
    for part in (scan(ev, PREV), ev):
        users = distinct.extend_users(part, path)
    return distinct.bitmap_counts(distinct.daily_user_bitmaps(ev, users), CUR, PREV)


def _q_approx(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts, and whether both kinds of approximate ones are within four standard errors (and one) of them."""
    ev, names = _ev(spark, d), ("users", "new_users", "sessions")
    exact = _summary(ev).select("type", *names)
    out = exact
    for tag, other, error in (("hll", kpi.kpi_summary(ev, CUR, PREV, "all", BULK_MIN, PATTERNS, approx=True), kpi.APPROX_ERROR),
                              ("sketch", distinct.sketch_counts(distinct.daily_sketches(ev), CUR, PREV), distinct.relative_error())):
        near = [F.abs(F.col(n) - F.col(f"a_{n}")) <= 4 * error * F.col(n) + 1 for n in names]
        other = other.select("type", *[F.col(n).alias(f"a_{n}") for n in names])
        out = out.join(other, "type").withColumn(f"{tag}_near", reduce(lambda a, b: a & b, near)).drop(*[f"a_{n}" for n in names])
    return out


def _q_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """First sources over a table bucketed by user, written and read again."""
    path = scratch_folder(spark, "bucketed")
    name = "events_" + path.rsplit("-", 1)[1]
    write_bucketed(_ev(spark, d), name, path, 4)
    return sessions.session_first_source(spark.table(name), covering(CUR, PREV))


def _q_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """The breakdowns of one render, one below the other."""
    shown = dashboard(_ev(spark, d), CUR, PREV, "all", "daily", BULK_MIN, PATTERNS, THRESHOLDS)
    names = {"regions": "location", "channels": "channel", "devices": "device", "demographics": "demographic"}
    frames = [getattr(shown, n).select(F.lit(n).alias("frame"), F.col(label).alias("label"), "rank", "current_revenue",
                                       "previous_revenue", "revenue_change_pct", "revenue_share") for n, label in names.items()]
    bulk_items = shown.bulk_items.select(F.lit("bulk_items").alias("frame"), F.col("product_name").alias("label"), "rank",
                                         F.col("item_revenue").alias("current_revenue"),
                                         *[F.lit(None).cast("double").alias(c) for c in ("previous_revenue", "revenue_change_pct")],
                                         "revenue_share")
    return reduce(DataFrame.unionByName, [*frames, bulk_items])


def _q_alerts(spark: SparkSession, d: str, source: str = "all", uncut: bool = False) -> DataFrame:
    ev = _ev(spark, d)
    return alerts.change_alerts(
        _summary(ev, source),
        breakdowns.product_post(breakdowns.product_performance(ev, CUR, PREV)),
        breakdowns.channel_performance(ev, CUR, PREV),
        breakdowns.demographic_performance(ev, CUR, PREV),
        breakdowns.geo_performance(ev, CUR, PREV),
        THRESHOLDS, uncut)


def _q_not_in(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    rng = covering(CUR, PREV)
    purchases = prepare(scan(ev, rng), "event_timestamp", "transaction_id", "event_name") \
        .where(F.col("event_name") == orders.PURCHASE).drop("event_name")
    repair = orders.repair_only_orders(ev, rng, PATTERNS)
    return orders.not_in_null_aware(purchases, "transaction_id", repair, "transaction_id", "kept")


def _q_events_per_day(spark: SparkSession, d: str) -> DataFrame:
    return (scan(_ev(spark, d), covering(CUR, PREV)).groupBy("event_date")
            .agg(F.count(F.lit(1)).alias("events")))


def _q_date_buckets(spark: SparkSession, d: str) -> DataFrame:
    days = scan(_ev(spark, d), covering(CUR, PREV)).select("event_date").distinct()
    day = parse_yyyymmdd(F.col("event_date"))
    return days.select("event_date", *[grain_start(day, g).cast("string").alias(f"{g}_label") for g in GRAINS])


def _q_purchase_items(spark: SparkSession, d: str) -> DataFrame:
    src = scan(_ev(spark, d), CUR).where(F.col("event_name") == orders.PURCHASE)
    return (prepare(src, "event_timestamp", "transaction_id",
                    it=item_fields("item_id", "item_name", "price", "quantity"))
            .select("event_timestamp", "transaction_id", F.explode("it").alias("it"))
            .select("event_timestamp", "transaction_id", "it.item_id", "it.item_name",
                    F.col("it.price").cast("double").alias("price"), "it.quantity"))


def registry() -> dict[str, Query]:
    return {
        "q1_kpi_summary": lambda s, d: _summary(_ev(s, d)),
        "q2_kpi_summary_store": lambda s, d: _summary(_ev(s, d), "store"),
        "q2_kpi_summary_online": lambda s, d: _summary(_ev(s, d), "online"),
        "q3_repair_only_orders": lambda s, d: orders.repair_only_orders(_ev(s, d), covering(CUR, PREV), PATTERNS),
        "q4_session_first_source": lambda s, d: sessions.session_first_source(_ev(s, d), covering(CUR, PREV)),
        "q5_store_sessions": lambda s, d: sessions.filter_sessions(
            sessions.session_first_source(_ev(s, d), covering(CUR, PREV))),
        "q6_trend_daily": lambda s, d: kpi.trend(_ev(s, d), CUR, "daily"),
        "q6_trend_weekly": lambda s, d: kpi.trend(_ev(s, d), CUR, "weekly"),
        "q6_trend_monthly": lambda s, d: kpi.trend(_ev(s, d), CUR, "monthly"),
        "q7_trend_store_daily": lambda s, d: kpi.trend(_ev(s, d), CUR, "daily", "store"),
        "q7_trend_online_weekly": lambda s, d: kpi.trend(_ev(s, d), CUR, "weekly", "online"),
        "q8_trend_conversion": lambda s, d: kpi.trend_conversion(kpi.trend(_ev(s, d), CUR, "daily")),
        "q9_product_performance": lambda s, d: breakdowns.product_performance(_ev(s, d), CUR, PREV),
        "q10_product_post": lambda s, d: breakdowns.product_post(breakdowns.product_performance(_ev(s, d), CUR, PREV)),
        "q11_channel_performance": lambda s, d: breakdowns.channel_performance(_ev(s, d), CUR, PREV),
        "q12_geo_performance": lambda s, d: breakdowns.geo_performance(_ev(s, d), CUR, PREV),
        "q13_device_performance": lambda s, d: breakdowns.device_performance(_ev(s, d), CUR, PREV),
        "q13_device_performance_null_safe": lambda s, d: breakdowns.device_performance(
            _ev(s, d), CUR, PREV, null_safe=True),
        "j3_geo_outer_join": lambda s, d: breakdowns.geo_performance(_ev(s, d), CUR, PREV, strategy="outer_join"),
        "j3_device_outer_join": lambda s, d: breakdowns.device_performance(
            _ev(s, d), CUR, PREV, strategy="outer_join"),
        "j3_device_outer_join_null_safe": lambda s, d: breakdowns.device_performance(
            _ev(s, d), CUR, PREV, null_safe=True, strategy="outer_join"),
        "q14_demographic_performance": lambda s, d: breakdowns.demographic_performance(_ev(s, d), CUR, PREV),
        "q15_normalize_demographics": lambda s, d: breakdowns.normalize_demographics(_ev(s, d), covering(CUR, PREV)),
        "q16_bulk_order_items": lambda s, d: bulk.bulk_order_items(_ev(s, d), CUR, BULK_MIN),
        "q17_kpi_derived": lambda s, d: kpi.kpi_derived(_summary(_ev(s, d))),
        "q18_revenue_share_bulk": lambda s, d: alerts.revenue_share(
            bulk.bulk_order_items(_ev(s, d), CUR, BULK_MIN), "product_name", "item_revenue"),
        "q18_revenue_share_geo": lambda s, d: alerts.revenue_share(
            breakdowns.geo_performance(_ev(s, d), CUR, PREV), "location"),
        "q18_revenue_share_channel": lambda s, d: alerts.revenue_share(
            breakdowns.channel_performance(_ev(s, d), CUR, PREV), "channel"),
        "q18_revenue_share_device": lambda s, d: alerts.revenue_share(
            breakdowns.device_performance(_ev(s, d), CUR, PREV, null_safe=True), "device"),
        "q18_revenue_share_demographic": lambda s, d: alerts.revenue_share(
            breakdowns.demographic_performance(_ev(s, d), CUR, PREV), "demographic"),
        "q11_channel_performance_filled": lambda s, d: breakdowns.channel_performance(
            _ev(s, d), CUR, PREV, fill_zero=True),
        "q12_geo_performance_filled": lambda s, d: breakdowns.geo_performance(_ev(s, d), CUR, PREV, fill_zero=True),
        "q13_device_performance_filled": lambda s, d: breakdowns.device_performance(
            _ev(s, d), CUR, PREV, null_safe=True, fill_zero=True),
        "q14_demographic_performance_filled": lambda s, d: breakdowns.demographic_performance(
            _ev(s, d), CUR, PREV, fill_zero=True),
        "q19_change_alerts": _q_alerts,
        "q19_change_alerts_online": lambda s, d: _q_alerts(s, d, "online"),
        "s1_double_money_bulk_items": _q_double_money,
        "s1_changing_partitions_geo": _q_changing_partitions,
        "s1_shards_kpi_summary": lambda s, d: _q_shards(s, d, _summary),
        "s4_shards_events_per_day": lambda s, d: _q_shards(
            s, d, lambda ev: ev.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))),
        "e1_dashboard_breakdowns": _q_dashboard,
        "e2_labels_geo": lambda s, d: breakdowns.geo_of(breakdowns.label_breakdowns(_ev(s, d), CUR, PREV)),
        "e2_labels_device": lambda s, d: breakdowns.device_of(breakdowns.label_breakdowns(_ev(s, d), CUR, PREV)),
        "e2_labels_demographic": lambda s, d: breakdowns.demographic_of(breakdowns.label_breakdowns(_ev(s, d), CUR, PREV)),
        "w3_rank_uncut_channels": lambda s, d: alerts.revenue_share(
            breakdowns.channel_performance(_ev(s, d), CUR, PREV, k=None), "channel", uncut=True),
        "q19_change_alerts_uncut": lambda s, d: _q_alerts(s, d, uncut=True),
        "a2_bitmap_users": _q_bitmaps,
        "j1_bucketed_first_source": _q_bucketed,
        "r4_approx_counts": _q_approx,
        "q2_kpi_summary_store_salted": lambda s, d: kpi.kpi_summary(_ev(s, d), CUR, PREV, "store", BULK_MIN, PATTERNS, session_salts=8),
        **{f"r2_grain_{name}": (lambda s, d, m=mode: _q_grain(
            s, d, lambda g: kpi.grain_kpi_summary(g, CUR, PREV, m, BULK_MIN, PATTERNS)))
           for name, mode in (("kpi_summary", "all"), ("kpi_summary_store", "store"), ("kpi_summary_online", "online"))},
        **{f"r2_grain_{name}": (lambda s, d, g=grain, m=mode: _q_grain(s, d, lambda t: kpi.grain_trend(t, CUR, g, m)))
           for name, grain, mode in (("trend_daily", "daily", "all"), ("trend_monthly", "monthly", "all"),
                                     ("trend_store_daily", "daily", "store"), ("trend_online_weekly", "weekly", "online"))},
        "p2_param_lookup": lambda s, d: prepare(_ev(s, d), "event_timestamp", "user_pseudo_id", "sid", "s_num",
                                                "param_source"),
        "p3_multi_key_lookup": lambda s, d: prepare(_ev(s, d), "event_timestamp", "user_pseudo_id", "ep_gender",
                                                    "up_gender", "ep_age", "up_age"),
        "r1_not_in_null_aware": _q_not_in,
        "s1_events_per_day": _q_events_per_day,
        "f1_f4_date_buckets": _q_date_buckets,
        "a11_latest_item_names": lambda s, d: breakdowns.latest_item_names(_ev(s, d), covering(CUR, PREV)),
        "j5_purchase_items": _q_purchase_items,
        "w2_session_channels": lambda s, d: sessions.session_channels(_ev(s, d), covering(CUR, PREV)),
    }
