"""Revenue shares, ranks and threshold-based change alerts.

Inputs are reduced frames: the two-row KPI summary and breakdowns.  Each is
read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arith import exact, share_pct
from tidemark.operators.ranks import by_value, ranks_of_first, with_rank
from tidemark.plans.periods import CURRENT, PREVIOUS

ALERT_COLUMNS = ["rule", "rank", "subject", "direction", "change", "change_pct"]


@dataclass(frozen=True)
class AlertThresholds:
    """A rule fires when the absolute change is strictly above its threshold."""

    # Default thresholds of the analytics being rebuilt.
    total_revenue_pct: float = 3.0
    product_revenue: float = 500_000
    channel_revenue: float = 300_000
    channel_sessions: float = 100
    demographic_revenue: float = 300_000
    demographic_sessions: float = 100
    bulk_revenue_pct: float = 10.0
    bulk_revenue_abs: float = 5_000_000
    region_revenue: float = 1_000_000
    conversion_pp: float = 0.15
    top_n: int = 3


def revenue_share(frame: DataFrame, label: str, revenue: str = "current_revenue", k: int | None = None,
                  uncut: bool = False) -> DataFrame:
    """Add ``rank`` (1.. by revenue desc, ties by label) and ``revenue_share`` of the frame's total.

    The share is ``round(revenue / total * 100, 1)`` over the rows of the
    frame, 0 when the total is not positive.  Without ``k`` the frame must be
    a display frame (already cut): ranks and total are windows over it.  With
    ``k`` or ``uncut`` it may have any size: the total is a one-row aggregate of
    all its rows; ``k`` ranks and returns the top ``k`` only, ``uncut`` all rows,
    by positions that are counted bucket by bucket (the frame is then read a few
    times, so it should be a written table).
    """
    if uncut:
        total = frame.select(F.sum(exact(F.col(revenue)))).scalar()
        ranked = with_rank(frame, by_value(F.col(revenue), F.col(label)))
        return ranked.withColumn("revenue_share", share_pct(F.col(revenue), total)).orderBy("rank")
    by_revenue = (F.col(revenue).desc_nulls_last(), F.col(label).asc_nulls_first())
    if k is None:
        total = F.sum(exact(F.col(revenue))).over(Window.partitionBy())
    else:
        total = frame.select(F.sum(exact(F.col(revenue)))).scalar()
        frame = frame.orderBy(*by_revenue).limit(k)
    return (frame.withColumn("rank", F.row_number().over(Window.orderBy(*by_revenue)))
            .withColumn("revenue_share", share_pct(F.col(revenue), total))
            .orderBy("rank"))


def _direction(change: Column) -> Column:
    return F.when(change > 0, F.lit("up")).otherwise(F.lit("down"))


def _alert(rule: str, rank: Column, subject: Column, change: Column, pct: Column, fires: Column) -> Column:
    """One possible alert row, with ``fires``: whether the rule fires for it."""
    change = change.cast("double")
    return F.struct(F.lit(rule).alias("rule"), rank.cast("int").alias("rank"), subject.cast("string").alias("subject"),
                    _direction(change).alias("direction"), change.alias("change"),
                    pct.cast("double").alias("change_pct"), fires.alias("fires"))


def _fired(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("a")).where("a.fires").select(*[f"a.{c}" for c in ALERT_COLUMNS])


def _period_values(summary: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``c_<col>`` and ``p_<col>``; previous falls back to current; empty without Current."""
    is_cur, is_prev = F.col("type") == CURRENT, F.col("type") == PREVIOUS
    piv = summary.agg(F.count_if(is_cur).alias("_hc"), F.count_if(is_prev).alias("_hp"),
                      *[F.max(F.when(is_cur, F.col(c))).alias(f"c_{c}") for c in cols],
                      *[F.max(F.when(is_prev, F.col(c))).alias(f"_p_{c}") for c in cols])
    return piv.where(F.col("_hc") > 0).select(
        *[F.col(f"c_{c}") for c in cols],
        *[F.when(F.col("_hp") > 0, F.col(f"_p_{c}")).otherwise(F.col(f"c_{c}")).alias(f"p_{c}") for c in cols])


def _rel_change(c: Column, p: Column) -> Column:
    # change / previous * 100, 0 when previous <= 0 (unrounded decimal).
    return F.when(p > 0, F.try_divide((exact(c) - exact(p)) * 100, exact(p))).otherwise(F.lit(0))


def _is_unknown(label: str) -> Column:
    return F.coalesce(F.col(label).contains("Unknown"), F.lit(False))


def _frame_alerts(frame: DataFrame, label: str, n: int, revenue: tuple[str, float],
                  sessions: tuple[str, float] | None = None, drop_unknown: bool = False, uncut: bool = False) -> DataFrame:
    """The alerts of one breakdown, which is read once (a few times if it is ``uncut``).

    Every row stands once for each rule; the rules then number their rows in
    one window keyed by the rule, which keeps at most ``n`` rows of a task
    before the shuffle.  Where 'Unknown' labels are dropped, the revenue rule
    needs positions from before that, so that window sees the display frame.
    """
    rev = F.col("current_revenue")
    rules = [F.struct(F.lit(revenue[0]).alias("rule"), rev.cast("double").alias("k1"), F.lit(0.0).alias("k2"),
                      F.col("revenue_change").cast("double").alias("change"),
                      F.coalesce("revenue_change_pct", F.lit(0)).cast("double").alias("pct"),
                      F.lit(float(revenue[1])).alias("limit"))]
    if sessions:
        rules.append(F.struct(F.lit(sessions[0]).alias("rule"), F.abs("sessions_change").cast("double").alias("k1"),
                              rev.cast("double").alias("k2"), F.col("sessions_change").cast("double").alias("change"),
                              F.coalesce("sessions_change_pct", F.lit(0)).cast("double").alias("pct"),
                              F.lit(float(sessions[1])).alias("limit")))
    rows = frame.select(F.col(label).alias("subject"), _is_unknown(label).alias("unknown"), F.explode(F.array(*rules)).alias("r"))
    order = Window.partitionBy("r.rule").orderBy(F.col("r.k1").desc_nulls_last(), F.col("r.k2").desc_nulls_last(),
                                                 F.col("subject").asc_nulls_first())
    if drop_unknown and uncut:
        of_revenue = F.col("r.rule") == revenue[0]
        top = ranks_of_first(rows.where(of_revenue), by_value(F.col("r.k1"), F.col("subject")), ~F.col("unknown"), n)
        others = rows.where(~F.col("unknown") & ~of_revenue).withColumn("rank", F.row_number().over(order))
        rows = top.unionByName(others.where(F.col("rank") <= n))
    elif drop_unknown:
        rows = rows.where(~F.col("unknown") | (F.col("r.rule") == revenue[0]))
        rows = rows.withColumn("rank", F.row_number().over(order)).where(~F.col("unknown"))
        known = Window.partitionBy("r.rule").orderBy("rank")
        rows = rows.withColumn("nth", F.row_number().over(known)).where(F.col("nth") <= n)
    else:
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return rows.where(F.abs("r.change") > F.col("r.limit")).select(
        F.col("r.rule").alias("rule"), F.col("rank").cast("int").alias("rank"), "subject",
        _direction(F.col("r.change")).alias("direction"), F.col("r.change").alias("change"), F.col("r.pct").alias("change_pct"))


def change_alerts(summary: DataFrame, products: DataFrame | None = None, channels: DataFrame | None = None,
                  demographics: DataFrame | None = None, regions: DataFrame | None = None,
                  thresholds: AlertThresholds = AlertThresholds(), uncut: bool = False) -> DataFrame:
    """Alert rows ``rule, rank, subject, direction, change, change_pct``; empty when nothing fires.

    Breakdown frames are in display order (current revenue desc).  Ranks are
    positions before the threshold test, so they can have holes; the
    demographic revenue rule keeps positions from before 'Unknown' labels are
    dropped, the two session rules number their own top rows.  With ``uncut``
    the demographics may have any size: no window sees more than a few of them.
    """
    t = thresholds
    pv = _period_values(summary, ["revenue", "bulk_revenue", "orders", "sessions"])
    chg = exact(F.col("c_revenue")) - exact(F.col("p_revenue"))
    rel = _rel_change(F.col("c_revenue"), F.col("p_revenue"))
    bchg = exact(F.col("c_bulk_revenue")) - exact(F.col("p_bulk_revenue"))
    brel = _rel_change(F.col("c_bulk_revenue"), F.col("p_bulk_revenue"))
    dec = "decimal(20,2)"
    cr = lambda o, s: F.when(F.col(s) > 0, F.try_divide(F.col(o).cast(dec) * 100, F.col(s).cast(dec))).otherwise(0)
    cr_chg = cr("c_orders", "c_sessions") - cr("p_orders", "p_sessions")
    none = F.lit(None)
    out = _fired(pv, _alert("total_revenue", none, F.lit("revenue"), chg, F.round(rel, 1), F.abs(rel) > t.total_revenue_pct),
                 _alert("bulk_revenue", none, F.lit("bulk_revenue"), bchg, F.round(brel, 1),
                        (F.abs(brel) > t.bulk_revenue_pct) | (F.abs(bchg) > t.bulk_revenue_abs)),
                 _alert("conversion_rate", none, F.lit("conversion_rate"), F.round(cr_chg, 2), none,
                        F.abs(cr_chg) > t.conversion_pp))
    n = t.top_n
    if products is not None:
        out = out.unionByName(_frame_alerts(products, "product_name", n, ("product_revenue", t.product_revenue)))
    if channels is not None:
        out = out.unionByName(_frame_alerts(channels, "channel", n, ("channel_revenue", t.channel_revenue),
                                            ("channel_sessions", t.channel_sessions)))
    if demographics is not None:
        out = out.unionByName(_frame_alerts(demographics, "demographic", n, ("demographic_revenue", t.demographic_revenue),
                                            ("demographic_sessions", t.demographic_sessions), drop_unknown=True,
                                            uncut=uncut))
    if regions is not None:
        out = out.unionByName(_frame_alerts(regions, "location", 1, ("top_region", t.region_revenue)))
    return out
