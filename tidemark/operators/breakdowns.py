"""Two-period breakdowns: product, channel, geography, device, demographics.

Each breakdown is a single pruned scan of the covering range followed by
conditional aggregation (``sum(when(period, x))``,
``count_distinct(when(period, key))``) — one pass for both periods instead of
a self-join.  Top-k cuts are ``orderBy(...).limit(k)`` (planned as
``TakeOrderedAndProject``) with a deterministic tie-breaker; the second-stage
re-sort and any share computation run on the at-most-k kept rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arith import MONEY, exact, money, pct_change, share_pct
from tidemark.operators.kpi import session_key
from tidemark.operators.orders import PURCHASE
from tidemark.operators.sessions import SESSION_KEY, channel_grain, channel_label, earliest
from tidemark.plans.periods import Period, covering
from tidemark.plans.prepare import item_fields, prepare
from tidemark.sources.events import scan

UNKNOWN = "Unknown"
# Raw (lower-cased) gender codes mapped to Male / Female.
MALE_CODES = ("male", "m", "male_ko", "1")
FEMALE_CODES = ("female", "f", "female_ko", "2")


def _is_purchase() -> Column:
    return F.col("event_name") == PURCHASE


def _fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.fill(0, subset=cols)


def _top_then_resort(df: DataFrame, label: str, k: int | None, change: str = "revenue_change",
                     fill_zero: bool = False) -> DataFrame:
    """Keep the ``k`` largest ``|change|`` rows, then order them by current revenue.

    ``fill_zero`` turns NULL percentages (previous value 0) into 0.
    """
    if fill_zero:
        df = _fill_zero(df, [c for c in df.columns if c.endswith("_pct")])
    if k is not None:
        df = df.orderBy(F.abs(F.col(change)).desc_nulls_last(), F.col(label).asc_nulls_first()).limit(k)
    return df.orderBy(F.col("current_revenue").desc_nulls_last(), F.col(label).asc_nulls_first())


def _with_session_changes(agg: DataFrame, label: str) -> DataFrame:
    c_rev, p_rev = F.col("c_rev"), F.col("p_rev")
    c_ses, p_ses = F.col("c_ses"), F.col("p_ses")
    return agg.select(
        F.col(label),
        money(c_rev).alias("current_revenue"),
        money(p_rev).alias("previous_revenue"),
        money(c_rev - p_rev).alias("revenue_change"),
        pct_change(c_rev, p_rev).alias("revenue_change_pct"),
        c_ses.alias("current_sessions"),
        p_ses.alias("previous_sessions"),
        (c_ses - p_ses).alias("sessions_change"),
        pct_change(c_ses, p_ses).alias("sessions_change_pct"),
    )


# ---------------------------------------------------------------- product (Q9, Q10)

def product_performance(events: DataFrame, cur: Period, prev: Period, k: int | None = 20,
                        fill_zero: bool = False) -> DataFrame:
    """Per item: revenue, sessions and quantity in both periods, named by its latest name.

    The cut depends on purchases alone, so purchases are summed and cut to the
    top ``k`` by current revenue first (ties by item id; ``k=None`` keeps all);
    the items of all other events are read only for the kept ids (join with
    at most ``k`` rows) to count sessions and find the latest name: the
    one at the greatest event date (ties: greatest name; NULL names lose
    ties).  Items without an id are dropped.
    """
    rng = covering(cur, prev)
    in_c, in_p = cur.contains("event_date"), prev.contains("event_date")
    sold = (prepare(scan(events, cur, prev), "event_date", "event_name", it=item_fields("item_id", "price", "quantity"))
            .where(_is_purchase()).select("event_date", F.explode("it").alias("it")).where(F.col("it.item_id").isNotNull()))
    line = F.coalesce(F.col("it.price").cast(MONEY), F.lit(0)) * F.coalesce(F.col("it.quantity"), F.lit(0))
    qty = F.coalesce(F.col("it.quantity"), F.lit(0))
    top = sold.groupBy(F.col("it.item_id").alias("item_id")).agg(
        F.sum(F.when(in_c, line).otherwise(0)).alias("c_rev"),
        F.sum(F.when(in_p, line).otherwise(0)).alias("p_rev"),
        F.sum(F.when(in_c, qty).otherwise(0)).alias("c_qty"),
        F.sum(F.when(in_p, qty).otherwise(0)).alias("p_qty"),
    ).where((F.col("c_rev") > 0) | (F.col("p_rev") > 0))
    by_revenue = (F.col("c_rev").desc(), F.col("item_id"))
    if k is not None:
        top = top.orderBy(*by_revenue).limit(k)
    seen = (prepare(scan(events, rng), "event_date", "user_pseudo_id", "sid", it=item_fields("item_id", "item_name"))
            .select("event_date", session_key(F.col("user_pseudo_id"), F.col("sid")).alias("skey"), F.explode("it").alias("it"))
            .select("event_date", "skey", "it.item_id", "it.item_name"))
    # With a cut, the join with at most k rows carries the figures along, so that purchases are summed once; without
    # one, the items' history is grouped by id alone and meets the figures when it is one row per item.
    if k is None:
        keys = ["item_id"]
        seen = seen.where(F.col("item_id").isNotNull())
    else:
        keys = top.columns
        seen = seen.join(top, "item_id")
    # One row per item, name and session, then one per item and session: sessions are counted as rows.
    named = seen.groupBy(*keys, "item_name", "skey").agg(
        F.max(F.col("event_date").cast("int")).alias("_d"), F.bool_or(in_c).alias("c_any"), F.bool_or(in_p).alias("p_any"))
    sessions = named.groupBy(*keys, "skey").agg(
        F.max(F.struct("_d", "item_name")).alias("_last"), F.bool_or("c_any").alias("c_any"), F.bool_or("p_any").alias("p_any"))
    known = F.col("skey").isNotNull()
    counted = sessions.groupBy(*keys).agg(
        F.count_if(F.col("c_any") & known).alias("c_ses"), F.count_if(F.col("p_any") & known).alias("p_ses"),
        F.max("_last").getField("item_name").alias("product_name"))
    kept = (top.join(counted, "item_id") if k is None else counted).orderBy(*by_revenue)
    kept = kept if k is None else kept.limit(k)  # planned as one top-k, not as a range sort
    out = kept.select(
        "product_name",
        money(F.col("c_rev")).alias("current_revenue"),
        money(F.col("p_rev")).alias("previous_revenue"),
        money(F.col("c_rev") - F.col("p_rev")).alias("revenue_change"),
        pct_change(F.col("c_rev"), F.col("p_rev")).alias("revenue_change_pct"),
        F.col("c_ses").alias("current_sessions"),
        F.col("p_ses").alias("previous_sessions"),
        F.col("c_qty").alias("current_quantity"),
        F.col("p_qty").alias("previous_quantity"),
    )
    return _fill_zero(out, ["revenue_change_pct"]) if fill_zero else out


def latest_item_names(events: DataFrame, period: Period | None = None) -> DataFrame:
    """``(item_id, product_name)``: each item's name at its greatest event date (ties: greatest name).

    Items without an id form no row.
    """
    src = scan(events, period) if period else events
    items = (prepare(src, "event_date", it=item_fields("item_id", "item_name"))
             .select("event_date", F.explode("it").alias("it"))
             .select("event_date", "it.item_id", "it.item_name")
             .where(F.col("item_id").isNotNull()))
    # Hash pre-aggregation to distinct (item, name) with the name's last date
    # (as an int, so the buffer stays fixed-width), then the string-valued
    # max_by runs on those few rows per item.
    last = items.groupBy("item_id", "item_name").agg(F.max(F.col("event_date").cast("int")).alias("_d"))
    return last.groupBy("item_id").agg(
        F.max_by("item_name", F.struct("_d", "item_name")).alias("product_name"))


def product_post(products: DataFrame) -> DataFrame:
    """Zero-fill, add session / quantity changes and revenue share of the kept rows, re-sort.

    ``products`` is the at-most-k-row result of ``product_performance``; the
    share's total is a window over that small frame.
    """
    filled = _fill_zero(products, ["revenue_change_pct"])
    total = F.sum(exact(F.col("current_revenue"))).over(Window.partitionBy())
    return (filled
            .withColumn("sessions_change", F.col("current_sessions") - F.col("previous_sessions"))
            .withColumn("quantity_change", F.col("current_quantity") - F.col("previous_quantity"))
            .withColumn("revenue_share", share_pct(F.col("current_revenue"), total))
            .orderBy(F.col("current_revenue").desc(), F.col("product_name"), F.col("previous_revenue").desc()))


# ---------------------------------------------------------------- channel (Q11)

def channel_performance(events: DataFrame, cur: Period, prev: Period, k: int | None = 10,
                        fill_zero: bool = False) -> DataFrame:
    """Per ``source / medium`` channel of the session's first non-blank values.

    A session is a (user, id) pair: ids are told apart even where user and id
    joined by "-" would read alike (negative ids).

    Two aggregations and no join: per session (channel inputs, per-period
    purchase revenue, presence), then per channel.  Each session has one
    channel, so session revenue and presence roll up exactly.
    """
    rng = covering(cur, prev)
    flat = prepare(scan(events, rng), "event_date", "user_pseudo_id", "sid", "event_name", "purchase_revenue",
                   "event_timestamp", "ts_source", "ts_medium")
    in_c, in_p = cur.contains("event_date"), prev.contains("event_date")
    rev0 = F.coalesce(F.col("purchase_revenue"), F.lit(0))
    p = _is_purchase()
    grain = channel_grain(flat,
                          c_rev=F.sum(F.when(in_c & p, rev0).otherwise(0)),
                          p_rev=F.sum(F.when(in_p & p, rev0).otherwise(0)),
                          c_any=F.bool_or(in_c), p_any=F.bool_or(in_p))
    per_session = grain.groupBy(*SESSION_KEY).agg(
        earliest(F.col("_s"), "_t").alias("_s"),
        earliest(F.col("_m"), "_t").alias("_m"),
        F.sum("c_rev").alias("c_rev"),
        F.sum("p_rev").alias("p_rev"),
        F.bool_or("c_any").alias("c_any"),
        F.bool_or("p_any").alias("p_any"),
    )
    # Each row is one session, so sessions are counted as rows; without user or id it is none.
    known = F.col("user_pseudo_id").isNotNull() & F.col("sid").isNotNull()
    agg = (per_session.groupBy(channel_label(F.col("_s"), F.col("_m")).alias("channel"))
           .agg(F.sum("c_rev").alias("c_rev"), F.sum("p_rev").alias("p_rev"),
                F.count_if(F.col("c_any") & known).alias("c_ses"),
                F.count_if(F.col("p_any") & known).alias("p_ses"))
           .where((F.col("c_rev") > 0) | (F.col("p_rev") > 0) | (F.col("c_ses") > 0) | (F.col("p_ses") > 0)))
    return _top_then_resort(_with_session_changes(agg, "channel"), "channel", k, fill_zero=fill_zero)


# ---------------------------------------------------------------- geo / device (Q12, Q13)

def _purchase_revenue_by(events: DataFrame, cur: Period, prev: Period, key: Column, label: str) -> DataFrame:
    flat = prepare(scan(events, cur, prev), "event_date", "event_name", "purchase_revenue", "country", "city",
                   "device").where(_is_purchase())
    in_c, in_p = cur.contains("event_date"), prev.contains("event_date")
    rev = F.col("purchase_revenue")
    return flat.groupBy(key.alias(label)).agg(
        F.sum(F.when(in_c, rev)).alias("c_rev"), F.sum(F.when(in_p, rev)).alias("p_rev"),
        F.count_if(in_c).alias("c_n"), F.count_if(in_p).alias("p_n"))


def _purchase_revenue_outer_join(events: DataFrame, cur: Period, prev: Period, key: Column, label: str,
                                 null_safe: bool) -> DataFrame:
    """Two one-period aggregates full-outer-joined on the key (plain ``=`` unless ``null_safe``).

    Each side scans only its own period's partitions and is aggregated
    (map-side combined) before the join, so the join sees one row per key.
    """
    def side(period: Period, name: str) -> DataFrame:
        flat = prepare(scan(events, period), "event_name", "purchase_revenue", "country", "city",
                       "device").where(_is_purchase())
        return flat.groupBy(key.alias(f"{name}_k")).agg(F.sum("purchase_revenue").alias(f"{name}_rev"))

    c, p = side(cur, "c"), side(prev, "p")
    cond = c["c_k"].eqNullSafe(p["p_k"]) if null_safe else c["c_k"] == p["p_k"]
    return c.join(p, cond, "full_outer").select(F.coalesce("c_k", "p_k").alias(label), "c_rev", "p_rev")


def _revenue_changes(agg: DataFrame, label: str) -> DataFrame:
    c = F.coalesce(F.col("c_rev"), F.lit(0))
    p = F.coalesce(F.col("p_rev"), F.lit(0))
    return agg.select(F.col(label), money(c).alias("current_revenue"), money(p).alias("previous_revenue"),
                      money(c - p).alias("revenue_change"), pct_change(c, p).alias("revenue_change_pct"))


STRATEGIES = ("conditional", "outer_join")


def _check_strategy(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")


def location_label() -> Column:
    return F.concat(F.coalesce(F.col("country"), F.lit(UNKNOWN)), F.lit(" / "), F.coalesce(F.col("city"), F.lit(UNKNOWN)))


def geo_performance(events: DataFrame, cur: Period, prev: Period, k: int | None = 10,
                    strategy: str = "conditional", fill_zero: bool = False) -> DataFrame:
    """Purchase revenue per ``country / city`` ('Unknown' for missing parts), top ``k`` by |change|.

    Scans only the two periods' partitions (gap days skipped).  ``strategy``:
    ``conditional`` (one scan, conditional sums) or ``outer_join`` (one
    aggregate per period, full outer join on the location); same result.
    """
    _check_strategy(strategy)
    loc = location_label()
    if strategy == "outer_join":
        agg = _purchase_revenue_outer_join(events, cur, prev, loc, "location", null_safe=False)
    else:
        agg = _purchase_revenue_by(events, cur, prev, loc, "location").where((F.col("c_n") > 0) | (F.col("p_n") > 0))
    return _top_then_resort(_revenue_changes(agg, "location"), "location", k, fill_zero=fill_zero)


def device_performance(events: DataFrame, cur: Period, prev: Period, null_safe: bool = False,
                       strategy: str = "conditional", fill_zero: bool = False) -> DataFrame:
    """Purchase revenue per device category, all categories.

    A NULL category never equals itself in the two-period outer match, so by
    default NULL yields separate current-only and previous-only rows;
    ``null_safe=True`` merges them into one row.  ``strategy`` as for
    ``geo_performance``.
    """
    _check_strategy(strategy)
    if strategy == "outer_join":
        agg = _purchase_revenue_outer_join(events, cur, prev, F.col("device"), "device", null_safe)
        return _top_then_resort(_revenue_changes(agg, "device"), "device", None, fill_zero=fill_zero)
    return _device_frame(_purchase_revenue_by(events, cur, prev, F.col("device"), "device"), null_safe, fill_zero)


def _device_frame(agg: DataFrame, null_safe: bool, fill_zero: bool) -> DataFrame:
    """Device rows from revenue and row counts of both periods; NULL is split in two unless ``null_safe``."""
    if not null_safe:
        split = F.when(F.col("device").isNull(), F.array(F.lit("c"), F.lit("p"))).otherwise(F.array(F.lit("b")))
        side = F.col("_side")
        agg = (agg.withColumn("_side", F.explode(split))
               .where((side == "b") | ((side == "c") & (F.col("c_n") > 0)) | ((side == "p") & (F.col("p_n") > 0)))
               .withColumn("c_rev", F.when(side != "p", F.col("c_rev")))
               .withColumn("p_rev", F.when(side != "c", F.col("p_rev"))))
    return _top_then_resort(_revenue_changes(agg, "device"), "device", None, fill_zero=fill_zero)


# ---------------------------------------------------------------- demographics (Q14, Q15)

def gender_label(raw: Column) -> Column:
    return (F.when(raw.isin(*MALE_CODES), F.lit("Male"))
            .when(raw.isin(*FEMALE_CODES), F.lit("Female"))
            .otherwise(F.lit(UNKNOWN)))


def demographic_columns() -> dict[str, Column]:
    """Gender and age of an event: event parameter first, then user property, then default.

    Gender is lower-cased (not trimmed) and mapped; an empty age parameter
    shadows the user property and then becomes 'Unknown'.
    """
    gender_raw = F.coalesce(F.lower(F.col("ep_gender")), F.lower(F.col("up_gender")), F.lit(""))
    age_raw = F.coalesce(F.col("ep_age"), F.col("up_age"), F.lit(UNKNOWN))
    gender = gender_label(gender_raw)
    age = F.coalesce(F.nullif(age_raw, F.lit("")), F.lit(UNKNOWN))
    return {"gender": gender, "age": age,
            "demographic": F.concat(gender, F.lit(" / "), age)}


def normalize_demographics(events: DataFrame, period: Period | None = None) -> DataFrame:
    """Per event: ``event_date, user_pseudo_id, sid, event_name, gender, age, demographic``."""
    src = scan(events, period) if period else events
    flat = prepare(src, "event_date", "user_pseudo_id", "sid", "event_name", "ep_gender", "up_gender",
                   "ep_age", "up_age")
    d = demographic_columns()
    return flat.select("event_date", "user_pseudo_id", "sid", "event_name",
                       d["gender"].alias("gender"), d["age"].alias("age"), d["demographic"].alias("demographic"))


def demographic_performance(events: DataFrame, cur: Period, prev: Period, k: int | None = 10,
                            fill_zero: bool = False) -> DataFrame:
    """Per ``gender / age`` label: purchase revenue and sessions in both periods, top ``k`` by |change|."""
    rng = covering(cur, prev)
    flat = prepare(scan(events, rng), "event_date", "user_pseudo_id", "sid", "event_name", "purchase_revenue",
                   "ep_gender", "up_gender", "ep_age", "up_age")
    in_c, in_p = cur.contains("event_date"), prev.contains("event_date")
    rev0 = F.coalesce(F.col("purchase_revenue"), F.lit(0))
    p = _is_purchase()
    # One row per label and session first: sessions are then counted as rows.
    grain = flat.groupBy(demographic_columns()["demographic"].alias("demographic"), *SESSION_KEY).agg(
        F.sum(F.when(in_c & p, rev0).otherwise(0)).alias("c_rev"),
        F.sum(F.when(in_p & p, rev0).otherwise(0)).alias("p_rev"),
        F.bool_or(in_c).alias("c_any"), F.bool_or(in_p).alias("p_any"))
    known = F.col("user_pseudo_id").isNotNull() & F.col("sid").isNotNull()
    agg = grain.groupBy("demographic").agg(
        F.sum("c_rev").alias("c_rev"), F.sum("p_rev").alias("p_rev"),
        F.count_if(F.col("c_any") & known).alias("c_ses"),
        F.count_if(F.col("p_any") & known).alias("p_ses"))
    return _top_then_resort(_with_session_changes(agg, "demographic"), "demographic", k, fill_zero=fill_zero)


# ---------------------------------------------------------------- all label breakdowns in one scan

#: Dimensions of ``label_breakdowns``.
GEO, DEVICE, DEMOGRAPHIC = "geo", "device", "demographic"


def label_breakdowns(events: DataFrame, cur: Period, prev: Period) -> DataFrame:
    """Figures of every (dimension, label) for geography, device and demographics from one scan.

    Every event stands for its demographic label and session, a purchase of one
    of the periods also for its location and device (few of all events).  One
    aggregate by dimension, label and session, then one by dimension and label;
    both combine map-side.  ``geo_of``, ``device_of`` and ``demographic_of`` make
    the breakdowns from the result, which has a row per label.
    """
    rng, in_c, in_p = covering(cur, prev), cur.contains("event_date"), prev.contains("event_date")
    flat = prepare(scan(events, rng), "event_date", "user_pseudo_id", "sid", "event_name", "purchase_revenue", "country",
                   "city", "device", "ep_gender", "up_gender", "ep_age", "up_age")
    nobody = [F.lit(None).cast("string").alias("user_pseudo_id"), F.lit(None).cast("bigint").alias("sid")]
    person = F.struct(F.lit(DEMOGRAPHIC).alias("dimension"), demographic_columns()["demographic"].alias("label"), *SESSION_KEY)
    place = F.struct(F.lit(GEO).alias("dimension"), location_label().alias("label"), *nobody)
    device = F.struct(F.lit(DEVICE).alias("dimension"), F.col("device").alias("label"), *nobody)
    bought = F.coalesce(_is_purchase(), F.lit(False))
    paid = F.when(bought, F.coalesce(F.col("purchase_revenue"), F.lit(0))).otherwise(0)
    rows = flat.select(in_c.alias("in_c"), in_p.alias("in_p"), paid.alias("paid"), F.explode(
        F.when(bought & (in_c | in_p), F.array(person, place, device)).otherwise(F.array(person))).alias("of"))
    grain = rows.select("in_c", "in_p", "paid", "of.*").groupBy("dimension", "label", *SESSION_KEY).agg(
        F.sum(F.when(F.col("in_c"), F.col("paid")).otherwise(0)).alias("c_rev"),
        F.sum(F.when(F.col("in_p"), F.col("paid")).otherwise(0)).alias("p_rev"),
        F.bool_or("in_c").alias("c_any"), F.bool_or("in_p").alias("p_any"))
    known = F.col("user_pseudo_id").isNotNull() & F.col("sid").isNotNull()
    return grain.groupBy("dimension", "label").agg(
        F.sum("c_rev").alias("c_rev"), F.sum("p_rev").alias("p_rev"),
        F.count_if(F.col("c_any") & known).alias("c_ses"), F.count_if(F.col("p_any") & known).alias("p_ses"),
        F.count_if("c_any").alias("c_n"), F.count_if("p_any").alias("p_n"))


def _of(labels: DataFrame, dimension: str, label: str) -> DataFrame:
    return labels.where(F.col("dimension") == dimension).drop("dimension").withColumnRenamed("label", label)


def geo_of(labels: DataFrame, k: int | None = 10, fill_zero: bool = False) -> DataFrame:
    """``geo_performance`` from ``label_breakdowns``."""
    return _top_then_resort(_revenue_changes(_of(labels, GEO, "location"), "location"), "location", k, fill_zero=fill_zero)


def device_of(labels: DataFrame, null_safe: bool = False, fill_zero: bool = False) -> DataFrame:
    """``device_performance`` from ``label_breakdowns``."""
    return _device_frame(_of(labels, DEVICE, "device"), null_safe, fill_zero)


def demographic_of(labels: DataFrame, k: int | None = 10, fill_zero: bool = False) -> DataFrame:
    """``demographic_performance`` from ``label_breakdowns``."""
    agg = _of(labels, DEMOGRAPHIC, "demographic")
    return _top_then_resort(_with_session_changes(agg, "demographic"), "demographic", k, fill_zero=fill_zero)
