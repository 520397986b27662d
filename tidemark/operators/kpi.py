"""KPI summary, trend, trend conversion and derived KPIs.

Plan shape (KPI summary and trend).  The date range is read as two nearly
disjoint column groups, each pre-aggregated at its own grain with map-side
combine (hot users, sessions or transactions collapse before any shuffle):

* session grain ``(bucket, user, sid)`` from ``user_pseudo_id`` and
  ``event_params`` -> users, new users, sessions;
* commerce grain ``(bucket, transaction)`` from ``event_name``,
  ``ecommerce`` and two item fields -> signups, revenue, orders, bulk and
  repair flags.  Per transaction, one more aggregation gives the repair-only
  flag and per-period figures; a global one-row aggregate then carries "set
  empty" and "set has NULL", which yields SQL ``NOT IN`` semantics without any
  join to the set.

Parquet reads each column once, so the two scans cost about one.  In a
source mode each grain also keeps ``(user, sid, source)`` with the earliest
time; a window over the pre-aggregated rows of a session gives its first
source, and only the rows of selected sessions go on: no third scan and no
join with the set of sessions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arith import exact, money, ratio
from tidemark.functions.dates import grain_start, parse_yyyymmdd
from tidemark.operators.grain import (
    BULK_MIN_REVENUE, COMMERCE_INPUTS, COMMERCE_MEASURES, SESSION_INPUTS, SESSION_MEASURES, check_rules, event_measures,
    item_inputs, merged_measures)
from tidemark.operators.orders import RepairPatterns, repair_only_flag
from tidemark.operators.sessions import SESSION_KEY, STORE_SOURCES, source_of_event
from tidemark.plans.periods import CURRENT, PREVIOUS, Period, covering, period_type
from tidemark.plans.prepare import prepare
from tidemark.sources.events import scan

KPI_COLUMNS = ["type", "users", "new_users", "sessions", "signups", "orders", "revenue",
               "bulk_orders", "bulk_revenue", "filtered_orders", "filtered_revenue"]


def session_key(user: Column, sid: Column, sep: str = "") -> Column:
    """Distinct-count key of a session: ``concat(user, [sep,] sid)``; NULL if either is NULL."""
    parts = [user, F.lit(sep), sid.cast("string")] if sep else [user, sid.cast("string")]
    return F.concat(*parts)


def _with_source(flat: DataFrame, mode: str) -> DataFrame:
    """For a source mode, the rows that belong to a session at all (inner-join semantics), with their source."""
    if mode == "all":
        return flat
    known = F.col("user_pseudo_id").isNotNull() & F.col("sid").isNotNull()
    return flat.where(known).withColumn("_src", source_of_event())


def _selected(grain: DataFrame, mode: str, store_sources: Iterable[str], salts: int = 1) -> DataFrame:
    """The grain's rows of sessions whose first source the mode selects.

    The grain holds each source of a session with its earliest time, so the
    window sees the few pre-aggregated rows of a session, not its events.  With
    ``salts`` a session is dealt over so many parts: a minimum of each part, a
    minimum of a session's parts, handed back to the parts by a join; no task
    then holds all rows of a session with very many transactions.
    """
    if mode == "all":
        return grain
    if mode not in ("store", "online"):
        raise ValueError(f"unknown source mode {mode!r}; expected all, store or online")
    earliest = F.min(F.struct("_t", "_src"))
    member = F.col("_first._src").isin(*list(store_sources))
    if salts <= 1:
        grain = grain.withColumn("_first", earliest.over(Window.partitionBy(*SESSION_KEY)))
    else:
        rest = [c for c in grain.columns if c in ("bucket", "transaction_id", "_src")]
        grain = grain.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)))
        parts = grain.groupBy(*SESSION_KEY, "_salt").agg(earliest.alias("_part"))
        first = F.min("_part").over(Window.partitionBy(*SESSION_KEY))
        grain = grain.join(parts.select(*SESSION_KEY, "_salt", first.alias("_first")), [*SESSION_KEY, "_salt"]).drop("_salt")
    return grain.where(member if mode == "store" else ~member)


def _grain_keys(mode: str, *keys: str) -> list[str]:
    return ["bucket", *dict.fromkeys([*keys, *([] if mode == "all" else [*SESSION_KEY, "_src"])])]


def _source_columns(mode: str) -> list[str]:
    return [] if mode == "all" else [*SESSION_KEY, "event_timestamp", "param_source", "ts_source"]


class _FromEvents:
    """The two grains of a summary or trend, each aggregated from the events by its own scan."""

    def __init__(self, events: DataFrame, bulk_min: float = BULK_MIN_REVENUE, patterns: RepairPatterns = RepairPatterns()):
        self.rows, self.measures = events, event_measures(bulk_min, patterns)

    def _grain(self, period: Period, bucket: Column, mode: str, inputs: Iterable[str], keys: Iterable[str],
               names: Iterable[str], **items: Column) -> DataFrame:
        cols = dict.fromkeys(["event_date", *inputs, *_source_columns(mode)])
        flat = _with_source(prepare(scan(self.rows, period), *cols, **items), mode)
        names = [*names, *([] if mode == "all" else ["_t"])]
        return flat.withColumn("bucket", bucket).groupBy(*_grain_keys(mode, *keys)).agg(
            *[self.measures[n].alias(n) for n in names])

    def visits(self, period: Period, bucket: Column) -> DataFrame:
        """The events as they are, for sketches that need no grain."""
        flat = prepare(scan(self.rows, period), "event_date", *SESSION_KEY, *SESSION_INPUTS)
        return flat.withColumn("bucket", bucket).withColumn("is_new", F.col("s_num") == 1)

    def sessions(self, period: Period, bucket: Column, mode: str) -> DataFrame:
        return self._grain(period, bucket, mode, [*SESSION_KEY, *SESSION_INPUTS], SESSION_KEY, SESSION_MEASURES)

    def commerce(self, period: Period, bucket: Column, mode: str) -> DataFrame:
        return self._grain(period, bucket, mode, ["transaction_id", *COMMERCE_INPUTS], ["transaction_id"],
                           COMMERCE_MEASURES, items=item_inputs())


class _FromGrain:
    """The same two grains, merged from rows of the daily grain."""

    def __init__(self, grain: DataFrame):
        self.rows = grain

    def _grain(self, period: Period, bucket: Column, mode: str, keys: Iterable[str], names: Iterable[str]) -> DataFrame:
        rows = scan(self.rows, period)
        if mode != "all":
            rows = rows.where(F.col("user_pseudo_id").isNotNull() & F.col("sid").isNotNull())
        names = [*names, *([] if mode == "all" else ["_t"])]
        return rows.withColumn("bucket", bucket).groupBy(*_grain_keys(mode, *keys)).agg(*merged_measures(names))

    def visits(self, period: Period, bucket: Column) -> DataFrame:
        return scan(self.rows, period).withColumn("bucket", bucket)

    def sessions(self, period: Period, bucket: Column, mode: str) -> DataFrame:
        return self._grain(period, bucket, mode, SESSION_KEY, SESSION_MEASURES)

    def commerce(self, period: Period, bucket: Column, mode: str) -> DataFrame:
        return self._grain(period, bucket, mode, ["transaction_id"], COMMERCE_MEASURES)


def kpi_summary(events: DataFrame, cur: Period, prev: Period, source: str = "all",
                bulk_min: float = BULK_MIN_REVENUE, patterns: RepairPatterns = RepairPatterns(),
                store_sources: Iterable[str] = STORE_SOURCES, gap_as_previous: bool = True, approx: bool = False,
                session_salts: int = 1) -> DataFrame:
    """One row per period type (Current / Previous) with the eleven KPI columns.

    The scan covers ``min(starts)..max(ends)``; every date outside the current
    period, gap days included, counts as Previous; without ``gap_as_previous``
    only the dates of the two periods count.  ``source`` is ``all``, ``store``
    or ``online`` (sessions whose first source over the same range is, or is
    not, one of ``store_sources``).  ``approx`` counts users, new users and
    sessions by HLL with a relative standard error of ``APPROX_ERROR``, without
    a grain of sessions in mode ``all``; other figures stay exact.
    ``session_salts`` deals the rows of a session over so many tasks in the
    source modes, for sessions with a large share of all transactions.
    """
    if not gap_as_previous:
        events = scan(events, cur, prev)
    return _summary(_FromEvents(events, bulk_min, patterns), cur, prev, source, store_sources, approx, session_salts)


def grain_kpi_summary(grain: DataFrame, cur: Period, prev: Period, source: str = "all",
                      bulk_min: float = BULK_MIN_REVENUE, patterns: RepairPatterns = RepairPatterns(),
                      store_sources: Iterable[str] = STORE_SOURCES, gap_as_previous: bool = True, approx: bool = False,
                      session_salts: int = 1) -> DataFrame:
    """``kpi_summary`` from the daily grain (``read_grain``), which must have been made with the same threshold and patterns."""
    check_rules(grain, bulk_min, patterns)
    if not gap_as_previous:
        grain = scan(grain, cur, prev)
    return _summary(_FromGrain(grain), cur, prev, source, store_sources, approx, session_salts)


#: Relative standard error of the approximate counts.
APPROX_ERROR = 0.01


def _summary(grains: _FromEvents | _FromGrain, cur: Period, prev: Period, source: str, store_sources: Iterable[str],
             approx: bool, salts: int) -> DataFrame:
    rng, bucket, user = covering(cur, prev), period_type(cur), F.col("user_pseudo_id")
    count = (lambda c: F.approx_count_distinct(c, APPROX_ERROR)) if approx else F.count_distinct
    ungrouped = approx and source == "all"
    sessions = grains.visits(rng, bucket) if ungrouped else _selected(grains.sessions(rng, bucket, source), source, store_sources, salts)
    per_type = (sessions.groupBy(F.col("bucket").alias("type"))
                .agg(count(user).alias("users"),
                     count(F.when(F.col("is_new"), user)).alias("new_users"),
                     count(session_key(user, F.col("sid"))).alias("sessions")))
    commerce = _commerce_metrics(_selected(grains.commerce(rng, bucket, source), source, store_sources, salts))
    all_null = F.col("_n_events") == F.col("_f_null_rev")
    return per_type.join(commerce, "type", "left").select(
        *KPI_COLUMNS[:-2],
        F.col("_f_orders").alias("filtered_orders"),
        F.when(all_null, F.lit(None)).otherwise(money(F.coalesce(F.col("_f_rev"), F.lit(0))))
        .cast("double").alias("filtered_revenue"),
    )


def _commerce_metrics(grain: DataFrame) -> DataFrame:
    """Per period type: signups, orders, revenue, bulk and NOT-IN-repair-only figures.

    Per transaction: the repair-only flag and per-type figures; then one
    global aggregate (one row) with per-type totals plus "set empty" and "set
    has NULL", from which the SQL ``NOT IN`` result is picked per type.
    """
    tx = F.col("transaction_id")
    periods = (("c", F.col("bucket") == CURRENT), ("p", F.col("bucket") != CURRENT))
    per_tx = grain.groupBy("transaction_id").agg(
        repair_only_flag(F.col("no_false"), F.col("any_true")).alias("repair"),
        *[a for k, cond in periods for a in (
            F.bool_or(F.col("p_any") & cond).alias(f"{k}_p"),
            F.bool_or(F.col("b_any") & cond).alias(f"{k}_b"),
            F.sum(F.when(cond, F.col("n_events"))).alias(f"{k}_n"),
            F.sum(F.when(cond, F.col("signups"))).alias(f"{k}_signups"),
            F.sum(F.when(cond, F.col("revenue"))).alias(f"{k}_revenue"),
            F.sum(F.when(cond, F.col("b_rev"))).alias(f"{k}_b_rev"),
            F.sum(F.when(cond, F.col("p_rev"))).alias(f"{k}_rev"),
            F.sum(F.when(cond, F.col("p_null_rev"))).alias(f"{k}_null"))],
    )
    repair = F.coalesce(F.col("repair"), F.lit(False))
    kept = tx.isNotNull() & ~repair
    aggs = [F.count_if(repair).alias("n_repair"),
            F.coalesce(F.bool_or(tx.isNull() & repair), F.lit(False)).alias("null_in_set")]
    for k, _ in periods:
        has = F.coalesce(F.col(f"{k}_p"), F.lit(False))
        aggs += [F.count_if(tx.isNotNull() & has).alias(f"{k}_all_orders"),
                 F.count_if(tx.isNotNull() & F.coalesce(F.col(f"{k}_b"), F.lit(False))).alias(f"{k}_bulk_orders"),
                 F.sum(f"{k}_n").alias(f"{k}_events"),
                 F.sum(f"{k}_signups").alias(f"{k}_signups"),
                 F.sum(f"{k}_revenue").alias(f"{k}_revenue"),
                 F.sum(f"{k}_b_rev").alias(f"{k}_bulk_revenue"),
                 F.sum(f"{k}_rev").alias(f"{k}_all_rev"),
                 F.sum(f"{k}_null").alias(f"{k}_all_null"),
                 F.count_if(kept & has).alias(f"{k}_kept_orders"),
                 F.sum(F.when(kept, F.col(f"{k}_rev"))).alias(f"{k}_kept_rev"),
                 F.sum(F.when(kept, F.col(f"{k}_null"))).alias(f"{k}_kept_null")]
    g = per_tx.agg(*aggs)

    def pick(k: str, what: str, none_value: Column) -> Column:
        return (F.when(F.col("n_repair") == 0, F.col(f"{k}_all_{what}"))
                .when(F.col("null_in_set"), none_value)
                .otherwise(F.col(f"{k}_kept_{what}")))

    rows = [F.struct(F.lit(label).alias("type"),
                     F.col(f"{k}_signups").cast("bigint").alias("signups"),
                     F.col(f"{k}_all_orders").alias("orders"),
                     money(F.col(f"{k}_revenue")).alias("revenue"),
                     F.col(f"{k}_bulk_orders").alias("bulk_orders"),
                     money(F.col(f"{k}_bulk_revenue")).alias("bulk_revenue"),
                     F.col(f"{k}_events").cast("bigint").alias("_n_events"),
                     pick(k, "orders", F.lit(0)).cast("bigint").alias("_f_orders"),
                     pick(k, "rev", F.lit(None)).alias("_f_rev"),
                     F.coalesce(pick(k, "null", F.lit(0)), F.lit(0)).cast("bigint").alias("_f_null_rev"))
            for label, k in ((CURRENT, "c"), (PREVIOUS, "p"))]
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def trend(events: DataFrame, cur: Period, grain: str = "daily", source: str = "all",
          store_sources: Iterable[str] = STORE_SOURCES) -> DataFrame:
    """``(period_label, sessions, revenue, orders)`` per day / week (Sunday start) / month of ``cur``.

    In a source mode the sessions are attributed over the current period only.
    """
    return _trend(_FromEvents(events), cur, grain, source, store_sources)


def grain_trend(daily: DataFrame, cur: Period, grain: str = "daily", source: str = "all",
                store_sources: Iterable[str] = STORE_SOURCES) -> DataFrame:
    """``trend`` from the daily grain."""
    return _trend(_FromGrain(daily), cur, grain, source, store_sources)


def _trend(grains: _FromEvents | _FromGrain, cur: Period, grain: str, source: str, store_sources: Iterable[str]) -> DataFrame:
    bucket = grain_start(parse_yyyymmdd(F.col("event_date")), grain).cast("string")
    user, tx = F.col("user_pseudo_id"), F.col("transaction_id")
    s = (_selected(grains.sessions(cur, bucket, source), source, store_sources)
         .groupBy(F.col("bucket").alias("period_label"))
         .agg(F.count_distinct(session_key(user, F.col("sid"))).alias("sessions")))
    c = (_selected(grains.commerce(cur, bucket, source), source, store_sources)
         .groupBy(F.col("bucket").alias("period_label"))
         .agg(money(F.sum("revenue")).alias("revenue"),
              F.count_distinct(F.when(F.col("p_any"), tx)).alias("orders")))
    return s.join(c, "period_label", "left").orderBy("period_label")


def trend_conversion(trend_df: DataFrame, digits: int = 2) -> DataFrame:
    """Add ``conversion_rate = orders / sessions * 100`` (0 when there are no sessions)."""
    return trend_df.withColumn(
        "conversion_rate",
        ratio(F.col("orders"), F.col("sessions"), 100, digits, zero_when_den_not_positive=True))


def _delta_pct(c: Column, p: Column) -> Column:
    # Relative change in percent, 0 when the previous value is 0 (difference taken exactly).
    return F.when(p == 0, F.lit(0.0)).otherwise(ratio(exact(c) - exact(p), p, 100, 1))


def kpi_derived(summary: DataFrame) -> DataFrame:
    """One row per KPI: ``kpi, current_value, previous_value, delta, delta_unit``.

    Previous falls back to Current when the summary has no Previous row (all
    deltas 0); no Current row gives an empty result.  Rates are percentages
    with 2 decimals, AOVs currency with 2 decimals; ``delta`` is a relative
    change in % (``pct``, 1 decimal), a point difference (``pp``, 2 decimals)
    or a plain difference (``diff``).
    """
    base = ["users", "new_users", "sessions", "signups", "orders", "revenue", "bulk_orders",
            "bulk_revenue", "filtered_orders", "filtered_revenue"]
    is_cur, is_prev = F.col("type") == CURRENT, F.col("type") == PREVIOUS
    piv = summary.agg(
        F.count_if(is_cur).alias("_has_cur"), F.count_if(is_prev).alias("_has_prev"),
        *[F.max(F.when(is_cur, F.col(c))).alias(f"c_{c}") for c in base],
        *[F.max(F.when(is_prev, F.col(c))).alias(f"p_{c}") for c in base],
    ).where(F.col("_has_cur") > 0)
    pv = lambda c: F.when(F.col("_has_prev") > 0, F.col(f"p_{c}")).otherwise(F.col(f"c_{c}"))
    cv = lambda c: F.col(f"c_{c}")

    def rate(num: Column, den: Column, scale: int) -> Column:
        return ratio(num, den, scale, 2, zero_when_den_not_positive=True)

    def row(name: str, c: Column, p: Column, delta: Column, unit: str | None) -> Column:
        return F.struct(F.lit(name).alias("kpi"), c.cast("double").alias("current_value"),
                        p.cast("double").alias("previous_value"), delta.cast("double").alias("delta"),
                        F.lit(unit).cast("string").alias("delta_unit"))

    rows = [row(k, cv(k), pv(k), _delta_pct(cv(k), pv(k)), "pct")
            for k in ("users", "new_users", "sessions", "signups", "orders", "revenue", "bulk_revenue")]
    # Rates: exact point difference of the unrounded rates, then rounded.
    nv_c, nv_p = rate(cv("new_users"), cv("users"), 100), rate(pv("new_users"), pv("users"), 100)
    cr_c, cr_p = rate(cv("orders"), cv("sessions"), 100), rate(pv("orders"), pv("sessions"), 100)
    rows += [row("new_visit_rate", nv_c, nv_p, _pp(cv("new_users"), cv("users"), pv("new_users"), pv("users")), "pp"),
             row("conversion_rate", cr_c, cr_p, _pp(cv("orders"), cv("sessions"), pv("orders"), pv("sessions")), "pp")]
    aov_c, aov_p = rate(cv("revenue"), cv("orders"), 1), rate(pv("revenue"), pv("orders"), 1)
    faov_c = rate(cv("filtered_revenue"), cv("filtered_orders"), 1)
    faov_p = rate(pv("filtered_revenue"), pv("filtered_orders"), 1)
    rows += [row("aov", aov_c, aov_p, _delta_of_quotients(cv, pv, "revenue", "orders"), "pct"),
             row("filtered_aov", faov_c, faov_p, _delta_of_quotients(cv, pv, "filtered_revenue", "filtered_orders"), "pct"),
             row("bulk_orders", cv("bulk_orders"), pv("bulk_orders"), cv("bulk_orders") - pv("bulk_orders"), "diff"),
             row("bulk_share", rate(cv("bulk_revenue"), cv("revenue"), 100),
                 rate(pv("bulk_revenue"), pv("revenue"), 100), F.lit(None), None)]
    return piv.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _delta_of_quotients(cv, pv, num: str, den: str) -> Column:
    """Relative change in percent of ``num / den``, from the unrounded quotients; a quotient without ``den`` is 0."""
    cn = F.when(cv(den) > 0, exact(cv(num))).otherwise(F.lit(0))
    cd = F.when(cv(den) > 0, cv(den)).otherwise(F.lit(1)).cast("decimal(10,0)")
    pn, pd = exact(pv(num)), pv(den).cast("decimal(10,0)")
    none = (pv(den) <= 0) | (pv(num) == 0)
    change = F.try_divide((cn * pd - pn * cd) * 100, pn * cd)
    return F.when(none, F.lit(0.0)).otherwise(F.round(change, 1).cast("double"))


def _pp(cn: Column, cd: Column, pn: Column, pd: Column) -> Column:
    """``round(cn/cd*100 - pn/pd*100, 2)`` with a 0 rate when a denominator is not positive."""
    dec = "decimal(20,2)"
    c = F.when(cd > 0, F.try_divide(cn.cast(dec) * 100, cd.cast(dec))).otherwise(F.lit(0))
    p = F.when(pd > 0, F.try_divide(pn.cast(dec) * 100, pd.cast(dec))).otherwise(F.lit(0))
    return F.round(c - p, 2)
