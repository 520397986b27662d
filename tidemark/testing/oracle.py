"""DuckDB oracle SQL for every registered query.

The oracle is an independent, *flat* rendering of the fixture: the driver's
tables are mapped straight to scalar columns (no nested arrays, no parameter
lookups), items come from a join with ``lineitem``/``part``, and each query
is plain SQL over that.  Rounded values use exact integer arithmetic
(DuckDB divides DECIMALs in DOUBLE), half away from zero.
"""

from __future__ import annotations

from tidemark.operators.sessions import STORE_SOURCES
from tidemark.testing.params import BULK_MIN, CHANGED, CUR, PATTERNS, PREV, THRESHOLDS

LO, HI = min(CUR.start, PREV.start), max(CUR.end, PREV.end)
IN_C = f"event_date BETWEEN '{CUR.start}' AND '{CUR.end}'"
IN_P = f"event_date BETWEEN '{PREV.start}' AND '{PREV.end}'"
PURCHASE = "event_name = 'purchase'"
STORE_LIST = ", ".join(f"'{s}'" for s in STORE_SOURCES)

FLAT = f"""
items_x AS (
  SELECT l.l_orderkey AS order_key, 'P' || CAST(l.l_partkey AS VARCHAR) AS item_id,
         p.p_name AS item_name, p.p_type AS item_category,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l.l_quantity AS BIGINT) AS quantity
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
),
ev AS (
  SELECT e.event_id,
         strftime(e.ts, '%Y%m%d') AS event_date,
         epoch_us(e.ts) AS event_timestamp,
         'u' || CAST(e.user_id AS VARCHAR) AS user_pseudo_id,
         CASE e.event_type WHEN 'signup' THEN 'sign_up' WHEN 'view' THEN 'view_item'
                           WHEN 'error' THEN 'page_view' ELSE e.event_type END AS event_name,
         CASE WHEN e.event_type = 'purchase' AND e.event_id % 29 <> 0
              THEN 'T' || CAST(e.event_id // 2 AS VARCHAR) END AS transaction_id,
         CASE WHEN e.event_type = 'purchase' AND e.event_id % 23 <> 0
              THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END AS purchase_revenue,
         CASE WHEN e.event_id % 17 <> 0 THEN epoch_us(e.ts) // 21600000000 END AS sid,
         CAST(1 + e.user_id % 3 AS BIGINT) AS s_num,
         CASE e.event_id % 4 WHEN 0 THEN 'QR_Store_247486' WHEN 1 THEN 'google' WHEN 3 THEN '' END AS param_source,
         CASE WHEN e.event_id % 6 = 0 THEN 'M' END AS ep_gender,
         CASE WHEN e.event_id % 7 = 0 THEN '' END AS ep_age,
         CASE e.user_id % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN '2' END AS up_gender,
         CASE e.user_id % 3 WHEN 0 THEN '20-29' WHEN 1 THEN '30-39' END AS up_age,
         CASE e.user_id % 4 WHEN 0 THEN 'Naver' WHEN 1 THEN ' ' WHEN 2 THEN 'google' END AS ts_source,
         CASE e.user_id % 5 WHEN 0 THEN 'organic' WHEN 1 THEN 'CPC' WHEN 2 THEN ''
                           WHEN 3 THEN 'referral' END AS ts_medium,
         CASE WHEN e.event_id % 31 <> 0 THEN r.r_name END AS country,
         n.n_name AS city,
         CASE e.event_id % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' WHEN 2 THEN 'tablet' END AS device,
         e.event_type IN ('purchase', 'view') AS has_items
  FROM events e
  JOIN orders o ON o.o_orderkey = e.event_id
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
),
ev_items AS (
  SELECT ev.*, i.item_id, i.item_name, i.item_category, i.price, i.quantity
  FROM ev JOIN items_x i ON i.order_key = ev.event_id
  WHERE ev.has_items
)"""


def with_flat(*ctes: str, flat: str = FLAT) -> str:
    return "WITH " + ",\n".join((flat,) + ctes)


def cents(x: str) -> str:
    """Integer cents of a money value (exact for DECIMAL and for DOUBLE outputs alike)."""
    return f"CAST(round(({x}) * 100) AS HUGEINT)"


def dec(x: str) -> str:
    return f"CAST(({x}) AS DECIMAL(38,2))"


def rnd(n: str, d: str, mult: int = 1, digits: int = 1, zero_when_nonpos: bool = False) -> str:
    """round(n * mult / d, digits) half away from zero as DOUBLE; n, d integer-valued; NULL if d = 0."""
    scale = 10 ** digits
    num = f"(CAST(({n}) AS HUGEINT) * {mult * scale})"
    den = f"CAST(({d}) AS HUGEINT)"
    q = f"(sign({num}) * sign({den}) * ((2 * abs({num}) + abs({den})) // (2 * abs({den}))))"
    val = f"CASE WHEN {den} = 0 THEN NULL ELSE CAST({q} AS DOUBLE) / {scale} END"
    if zero_when_nonpos:
        return f"CASE WHEN ({d}) > 0 THEN {val} ELSE 0.0 END"
    return val


def pct_money(c: str, p: str) -> str:
    return rnd(cents(f"({c}) - ({p})"), cents(p), 100, 1)


def pct_count(c: str, p: str) -> str:
    return rnd(f"({c}) - ({p})", p, 100, 1)


def repair_pred(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    up = PATTERNS.upper_pattern
    return (f"(regexp_matches(upper(coalesce({a}item_category, '')), '{up}') OR "
            f"regexp_matches(upper(coalesce({a}item_name, '')), '{up}') OR "
            f"regexp_matches({a}item_name, '{PATTERNS.name_pattern}'))")


def first_source_cte(name: str, src: str) -> str:
    """Source of the events at a session's first time (ties: the smallest)."""
    return f"""{name} AS (
  SELECT e.user_pseudo_id, e.sid, min(lower(coalesce(e.param_source, e.ts_source, '(direct)'))) AS first_source
  FROM {src} e JOIN (SELECT user_pseudo_id AS u, sid AS k, min(event_timestamp) AS t FROM {src} GROUP BY 1, 2) f
    ON e.user_pseudo_id IS NOT DISTINCT FROM f.u AND e.sid IS NOT DISTINCT FROM f.k AND e.event_timestamp = f.t
  GROUP BY 1, 2)"""


def _kpi_body(base: str) -> str:
    bulk = f"{PURCHASE} AND purchase_revenue >= {BULK_MIN}"
    notin = f"{PURCHASE} AND transaction_id NOT IN (SELECT transaction_id FROM repair)"
    return f"""repair AS (
  SELECT transaction_id FROM {base}_items WHERE {PURCHASE}
  GROUP BY transaction_id HAVING bool_and({repair_pred()}))
SELECT CASE WHEN {IN_C} THEN 'Current' ELSE 'Previous' END AS type,
       COUNT(DISTINCT user_pseudo_id) AS users,
       COUNT(DISTINCT CASE WHEN s_num = 1 THEN user_pseudo_id END) AS new_users,
       COUNT(DISTINCT user_pseudo_id || CAST(sid AS VARCHAR)) AS sessions,
       COUNT(*) FILTER (WHERE event_name = 'sign_up') AS signups,
       COUNT(DISTINCT CASE WHEN {PURCHASE} THEN transaction_id END) AS orders,
       CAST(SUM(COALESCE(purchase_revenue, 0)) AS DOUBLE) AS revenue,
       COUNT(DISTINCT CASE WHEN {bulk} THEN transaction_id END) AS bulk_orders,
       CAST(SUM(CASE WHEN {bulk} THEN purchase_revenue ELSE 0 END) AS DOUBLE) AS bulk_revenue,
       COUNT(DISTINCT CASE WHEN {notin} THEN transaction_id END) AS filtered_orders,
       CAST(SUM(CASE WHEN {notin} THEN purchase_revenue ELSE 0 END) AS DOUBLE) AS filtered_revenue
FROM {base} GROUP BY 1"""


def kpi_sql(source: str = "all", flat: str = FLAT) -> str:
    ctes = [f"base AS (SELECT * FROM ev WHERE event_date BETWEEN '{LO}' AND '{HI}')"]
    name = "base"
    if source != "all":
        op = "IN" if source == "store" else "NOT IN"
        ctes += [first_source_cte("sfs", "base"),
                 f"""sel AS (
  SELECT b.* FROM base b JOIN sfs s ON b.user_pseudo_id = s.user_pseudo_id AND b.sid = s.sid
  WHERE s.first_source {op} ({STORE_LIST}))"""]
        name = "sel"
    ctes.append(f"""{name}_items AS (
  SELECT b.*, i.item_id, i.item_name, i.item_category FROM {name} b
  JOIN items_x i ON i.order_key = b.event_id WHERE b.has_items)""")
    return with_flat(*ctes, _kpi_body(name), flat=flat)


GRAIN_SQL = {
    "daily": "d",
    "weekly": "CAST(d - CAST(dayofweek(d) AS INTEGER) AS DATE)",
    "monthly": "CAST(date_trunc('month', d) AS DATE)",
}


def trend_sql(grain: str, source: str = "all", conversion: bool = False) -> str:
    ctes = [f"base AS (SELECT *, CAST(strptime(event_date, '%Y%m%d') AS DATE) AS d FROM ev "
            f"WHERE {IN_C})"]
    name = "base"
    if source != "all":
        op = "IN" if source == "store" else "NOT IN"
        ctes += [first_source_cte("sfs", "base"),
                 f"""sel AS (
  SELECT b.* FROM base b JOIN sfs s ON b.user_pseudo_id = s.user_pseudo_id AND b.sid = s.sid
  WHERE s.first_source {op} ({STORE_LIST}))"""]
        name = "sel"
    body = f"""t AS (
  SELECT CAST({GRAIN_SQL[grain]} AS VARCHAR) AS period_label,
         COUNT(DISTINCT user_pseudo_id || CAST(sid AS VARCHAR)) AS sessions,
         CAST(SUM(COALESCE(purchase_revenue, 0)) AS DOUBLE) AS revenue,
         COUNT(DISTINCT CASE WHEN {PURCHASE} THEN transaction_id END) AS orders
  FROM {name} GROUP BY 1)"""
    conv = f", {rnd('orders', 'sessions', 100, 2, True)} AS conversion_rate" if conversion else ""
    return with_flat(*ctes, body) + f"\nSELECT *{conv} FROM t"


PRODUCT_BODY = f"""pi AS (
  SELECT * FROM ev_items WHERE event_date BETWEEN '{LO}' AND '{HI}' AND item_id IS NOT NULL),
names AS (
  SELECT item_id, item_name AS product_name FROM (
    SELECT item_id, item_name,
           row_number() OVER (PARTITION BY item_id ORDER BY event_date DESC, item_name DESC NULLS LAST) AS rn
    FROM pi) t WHERE rn = 1),
m AS (
  SELECT item_id,
    SUM(CASE WHEN {IN_C} AND {PURCHASE} THEN COALESCE(price, 0) * COALESCE(quantity, 0) ELSE 0 END) AS c_rev,
    SUM(CASE WHEN {IN_P} AND {PURCHASE} THEN COALESCE(price, 0) * COALESCE(quantity, 0) ELSE 0 END) AS p_rev,
    COUNT(DISTINCT CASE WHEN {IN_C} THEN user_pseudo_id || CAST(sid AS VARCHAR) END) AS c_ses,
    COUNT(DISTINCT CASE WHEN {IN_P} THEN user_pseudo_id || CAST(sid AS VARCHAR) END) AS p_ses,
    SUM(CASE WHEN {IN_C} AND {PURCHASE} THEN COALESCE(quantity, 0) ELSE 0 END) AS c_qty,
    SUM(CASE WHEN {IN_P} AND {PURCHASE} THEN COALESCE(quantity, 0) ELSE 0 END) AS p_qty
  FROM pi GROUP BY item_id),
prod AS (
  SELECT n.product_name,
         CAST(m.c_rev AS DOUBLE) AS current_revenue,
         CAST(m.p_rev AS DOUBLE) AS previous_revenue,
         CAST(m.c_rev - m.p_rev AS DOUBLE) AS revenue_change,
         {pct_money('m.c_rev', 'm.p_rev')} AS revenue_change_pct,
         m.c_ses AS current_sessions, m.p_ses AS previous_sessions,
         CAST(m.c_qty AS BIGINT) AS current_quantity, CAST(m.p_qty AS BIGINT) AS previous_quantity
  FROM m JOIN names n ON n.item_id = m.item_id
  WHERE m.c_rev > 0 OR m.p_rev > 0
  ORDER BY m.c_rev DESC, m.item_id LIMIT 20)"""

PRODUCT_SELECT = "SELECT * FROM prod"
PRODUCT_POST_SELECT = f"""SELECT product_name, current_revenue, previous_revenue, revenue_change,
       COALESCE(revenue_change_pct, 0) AS revenue_change_pct, current_sessions, previous_sessions,
       current_quantity, previous_quantity,
       current_sessions - previous_sessions AS sessions_change,
       current_quantity - previous_quantity AS quantity_change,
       {rnd(cents('current_revenue'), f"SUM({cents('current_revenue')}) OVER ()", 100, 1, True)} AS revenue_share
FROM prod"""


def _session_breakdown_select(agg: str, label: str, where: str, k: int) -> str:
    return f"""SELECT {label},
       CAST(COALESCE(c_rev, 0) AS DOUBLE) AS current_revenue,
       CAST(COALESCE(p_rev, 0) AS DOUBLE) AS previous_revenue,
       CAST(COALESCE(c_rev - p_rev, 0) AS DOUBLE) AS revenue_change,
       {pct_money('c_rev', 'p_rev')} AS revenue_change_pct,
       COALESCE(c_ses, 0) AS current_sessions,
       COALESCE(p_ses, 0) AS previous_sessions,
       COALESCE(c_ses - p_ses, 0) AS sessions_change,
       {pct_count('c_ses', 'p_ses')} AS sessions_change_pct
FROM {agg} {where}
ORDER BY abs(COALESCE(c_rev - p_rev, 0)) DESC, {label} NULLS FIRST LIMIT {k}"""


def _trimmed(c: str) -> str:
    return f"lower(NULLIF(regexp_replace(COALESCE({c}, ''), '^\\s+|\\s+$', '', 'g'), ''))"


def _earliest_label(name: str, label: str) -> str:
    """Per session the value of ``label`` at the first time that has one."""
    return f"""{name} AS (
  SELECT c.user_pseudo_id AS u, c.sid AS k, min(c.{label}) AS v
  FROM labels_of c JOIN (SELECT user_pseudo_id AS u, sid AS k, min(event_timestamp) AS t FROM labels_of
                         WHERE {label} IS NOT NULL GROUP BY 1, 2) m
    ON c.user_pseudo_id IS NOT DISTINCT FROM m.u AND c.sid IS NOT DISTINCT FROM m.k AND c.event_timestamp = m.t
  WHERE c.{label} IS NOT NULL GROUP BY 1, 2)"""


CHANNEL_BODY = f"""labels_of AS (
  SELECT *, {_trimmed('ts_source')} AS src_label, {_trimmed('ts_medium')} AS med_label
  FROM ev WHERE event_date BETWEEN '{LO}' AND '{HI}'),
{_earliest_label('src_of', 'src_label')},
{_earliest_label('med_of', 'med_label')},
in_channel AS (
  SELECT l.*, coalesce(x.v, '(direct)') || ' / ' || coalesce(y.v, '(none)') AS channel
  FROM labels_of l
  LEFT JOIN src_of x ON l.user_pseudo_id IS NOT DISTINCT FROM x.u AND l.sid IS NOT DISTINCT FROM x.k
  LEFT JOIN med_of y ON l.user_pseudo_id IS NOT DISTINCT FROM y.u AND l.sid IS NOT DISTINCT FROM y.k),
chan_agg AS (
  SELECT channel,
    SUM(CASE WHEN {IN_C} AND {PURCHASE} THEN COALESCE(purchase_revenue, 0) ELSE 0 END) AS c_rev,
    SUM(CASE WHEN {IN_P} AND {PURCHASE} THEN COALESCE(purchase_revenue, 0) ELSE 0 END) AS p_rev,
    COUNT(DISTINCT CASE WHEN {IN_C} THEN user_pseudo_id || '-' || CAST(sid AS VARCHAR) END) AS c_ses,
    COUNT(DISTINCT CASE WHEN {IN_P} THEN user_pseudo_id || '-' || CAST(sid AS VARCHAR) END) AS p_ses
  FROM in_channel GROUP BY 1),
chan AS ({_session_breakdown_select('chan_agg', 'channel',
                                    'WHERE c_rev > 0 OR p_rev > 0 OR c_ses > 0 OR p_ses > 0', 10)})"""

DEMO_EXPR = """CASE WHEN g IN ('male', 'm', 'male_ko', '1') THEN 'Male'
            WHEN g IN ('female', 'f', 'female_ko', '2') THEN 'Female' ELSE 'Unknown' END
       || ' / ' || COALESCE(NULLIF(a, ''), 'Unknown')"""

DEMO_BASE = f"""db AS (
  SELECT *, COALESCE(lower(ep_gender), lower(up_gender), '') AS g,
            COALESCE(ep_age, up_age, 'Unknown') AS a
  FROM ev WHERE event_date BETWEEN '{LO}' AND '{HI}')"""

DEMO_BODY = f"""{DEMO_BASE},
demo_agg AS (
  SELECT {DEMO_EXPR} AS demographic,
    SUM(CASE WHEN {IN_C} AND {PURCHASE} THEN COALESCE(purchase_revenue, 0) ELSE 0 END) AS c_rev,
    SUM(CASE WHEN {IN_P} AND {PURCHASE} THEN COALESCE(purchase_revenue, 0) ELSE 0 END) AS p_rev,
    COUNT(DISTINCT CASE WHEN {IN_C} THEN user_pseudo_id || '-' || CAST(sid AS VARCHAR) END) AS c_ses,
    COUNT(DISTINCT CASE WHEN {IN_P} THEN user_pseudo_id || '-' || CAST(sid AS VARCHAR) END) AS p_ses
  FROM db GROUP BY 1),
demo AS ({_session_breakdown_select('demo_agg', 'demographic', '', 10)})"""


def _two_scan_body(name: str, key: str, label: str, limit: str) -> str:
    return f"""{name}_c AS (
  SELECT {key} AS k, SUM(purchase_revenue) AS revenue FROM ev WHERE {IN_C} AND {PURCHASE} GROUP BY 1),
{name}_p AS (
  SELECT {key} AS k, SUM(purchase_revenue) AS revenue FROM ev WHERE {IN_P} AND {PURCHASE} GROUP BY 1),
{name} AS (
  SELECT COALESCE(c.k, p.k) AS {label},
         CAST(COALESCE(c.revenue, 0) AS DOUBLE) AS current_revenue,
         CAST(COALESCE(p.revenue, 0) AS DOUBLE) AS previous_revenue,
         CAST(COALESCE(c.revenue, 0) - COALESCE(p.revenue, 0) AS DOUBLE) AS revenue_change,
         {pct_money('COALESCE(c.revenue, 0)', 'COALESCE(p.revenue, 0)')} AS revenue_change_pct
  FROM {name}_c c FULL OUTER JOIN {name}_p p ON c.k = p.k
  ORDER BY abs(COALESCE(c.revenue, 0) - COALESCE(p.revenue, 0)) DESC, 1 NULLS FIRST {limit})"""


GEO_BODY = _two_scan_body("geo", "COALESCE(country, 'Unknown') || ' / ' || COALESCE(city, 'Unknown')",
                          "location", "LIMIT 10")
DEVICE_BODY = _two_scan_body("dev", "device", "device", "")

BULK_BODY = f"""bulk AS (
  SELECT item_name AS product_name, COUNT(DISTINCT transaction_id) AS order_count,
         CAST(SUM(quantity) AS BIGINT) AS total_quantity,
         CAST(SUM(price * quantity) AS DOUBLE) AS item_revenue
  FROM ev_items WHERE {IN_C} AND {PURCHASE} AND purchase_revenue >= {BULK_MIN}
  GROUP BY 1 ORDER BY item_revenue DESC NULLS LAST, product_name NULLS FIRST LIMIT 20)"""


def share_select(src: str, label: str, revenue: str) -> str:
    return f"""SELECT *,
       CAST(row_number() OVER (ORDER BY {revenue} DESC NULLS LAST, {label} NULLS FIRST) AS INTEGER) AS rank,
       {rnd(cents(revenue), f"SUM({cents(revenue)}) OVER ()", 100, 1, True)} AS revenue_share
FROM {src}"""


def qround(n: str, d: str) -> str:
    """Integer ``round(n / d)`` half away from zero (HUGEINT); n, d integer-valued, d != 0."""
    return (f"(sign(CAST(({n}) AS HUGEINT)) * sign(CAST(({d}) AS HUGEINT)) * "
            f"((2 * abs(CAST(({n}) AS HUGEINT)) + abs(CAST(({d}) AS HUGEINT))) // (2 * abs(CAST(({d}) AS HUGEINT)))))")


def _pp(a: str, b: str, c: str, d: str) -> str:
    """round(a/b*100 - c/d*100, 2), a rate being 0 when its denominator is not positive."""
    return f"""CASE WHEN ({b}) > 0 AND ({d}) > 0 THEN {rnd(f'({a}) * ({d}) - ({c}) * ({b})', f'({b}) * ({d})', 100, 2)}
            WHEN ({b}) > 0 THEN {rnd(a, b, 100, 2)}
            WHEN ({d}) > 0 THEN {rnd(f'-({c})', d, 100, 2)} ELSE 0.0 END"""


def _kpi_cte(source: str = "all") -> str:
    """The KPI summary of a source mode as CTE ``summ`` plus period values ``pv`` (c_*, p_*)."""
    body = kpi_sql(source)
    inner = body[len("WITH "):]
    cols = ["users", "new_users", "sessions", "signups", "orders", "revenue", "bulk_orders", "bulk_revenue",
            "filtered_orders", "filtered_revenue"]
    sel_c = ", ".join(f"c.{k} AS c_{k}" for k in cols)
    sel_p = ", ".join(f"CASE WHEN p.type IS NULL THEN c.{k} ELSE p.{k} END AS p_{k}" for k in cols)
    split = inner.rindex("SELECT CASE WHEN")
    return (inner[:split].rstrip().rstrip(",") + ",\nsumm AS (" + inner[split:] + "),\n"
            f"pv AS (SELECT {sel_c}, {sel_p} FROM (SELECT * FROM summ WHERE type = 'Current') c "
            f"LEFT JOIN (SELECT * FROM summ WHERE type = 'Previous') p ON TRUE)")


def kpi_derived_sql() -> str:
    rows = []

    def row(name: str, cur: str, prev: str, delta: str, unit: str | None) -> str:
        u = f"'{unit}'" if unit else "CAST(NULL AS VARCHAR)"
        return (f"SELECT '{name}' AS kpi, CAST({cur} AS DOUBLE) AS current_value, CAST({prev} AS DOUBLE) AS "
                f"previous_value, CAST({delta} AS DOUBLE) AS delta, {u} AS delta_unit FROM pv")

    for k in ("users", "new_users", "sessions", "signups", "orders"):
        rows.append(row(k, f"c_{k}", f"p_{k}",
                        f"CASE WHEN p_{k} = 0 THEN 0.0 ELSE {rnd(f'c_{k} - p_{k}', f'p_{k}', 100, 1)} END", "pct"))
    for k in ("revenue", "bulk_revenue"):
        rows.append(row(k, f"c_{k}", f"p_{k}",
                        f"CASE WHEN p_{k} = 0 THEN 0.0 ELSE {rnd(cents(f'c_{k} - p_{k}'), cents(f'p_{k}'), 100, 1)} END",
                        "pct"))
    rows.append(row("new_visit_rate", rnd("c_new_users", "c_users", 100, 2, True),
                    rnd("p_new_users", "p_users", 100, 2, True),
                    _pp("c_new_users", "c_users", "p_new_users", "p_users"), "pp"))
    rows.append(row("conversion_rate", rnd("c_orders", "c_sessions", 100, 2, True),
                    rnd("p_orders", "p_sessions", 100, 2, True),
                    _pp("c_orders", "c_sessions", "p_orders", "p_sessions"), "pp"))
    for name, rev, cnt in (("aov", "revenue", "orders"), ("filtered_aov", "filtered_revenue", "filtered_orders")):
        value = lambda side: (f"CAST(CASE WHEN {side}_{cnt} > 0 THEN {qround(cents(f'{side}_{rev}'), f'{side}_{cnt}')} "  # noqa: E731
                              f"ELSE 0 END AS DOUBLE) / 100")
        c_n = f"CASE WHEN c_{cnt} > 0 THEN {cents(f'c_{rev}')} ELSE 0 END"
        c_d = f"CASE WHEN c_{cnt} > 0 THEN c_{cnt} ELSE 1 END"
        p_n = cents(f"p_{rev}")
        delta = rnd(f"({c_n}) * p_{cnt} - {p_n} * ({c_d})", f"{p_n} * ({c_d})", 100, 1)
        rows.append(row(name, value("c"), value("p"),
                        f"CASE WHEN p_{cnt} <= 0 OR {p_n} = 0 THEN 0.0 ELSE {delta} END", "pct"))
    rows.append(row("bulk_orders", "c_bulk_orders", "p_bulk_orders", "c_bulk_orders - p_bulk_orders", "diff"))
    rows.append(row("bulk_share", rnd(cents("c_bulk_revenue"), cents("c_revenue"), 100, 2, True),
                    rnd(cents("p_bulk_revenue"), cents("p_revenue"), 100, 2, True), "NULL", None))
    return "WITH " + _kpi_cte() + "\n" + "\nUNION ALL\n".join(rows)


def _alert(src: str, rule: str, rank: str, subject: str, change: str, pct: str, where: str) -> str:
    return (f"SELECT '{rule}' AS rule, CAST({rank} AS INTEGER) AS rank, CAST({subject} AS VARCHAR) AS subject, "
            f"CASE WHEN {change} > 0 THEN 'up' ELSE 'down' END AS direction, CAST({change} AS DOUBLE) AS change, "
            f"CAST({pct} AS DOUBLE) AS change_pct FROM {src} WHERE {where}")


def alerts_sql(source: str = "all") -> str:
    t = THRESHOLDS
    n = t.top_n
    ctes = [_kpi_cte(source), PRODUCT_BODY, f"pp AS ({PRODUCT_POST_SELECT})", CHANNEL_BODY, DEMO_BODY, GEO_BODY]
    rank_by_rev = lambda lab: f"row_number() OVER (ORDER BY current_revenue DESC NULLS LAST, {lab} NULLS FIRST)"
    ctes += [
        f"pr AS (SELECT *, {rank_by_rev('product_name')} AS r FROM pp)",
        f"cr AS (SELECT *, COALESCE(revenue_change_pct, 0) AS rpct, COALESCE(sessions_change_pct, 0) AS spct, "
        f"{rank_by_rev('channel')} AS r, row_number() OVER (ORDER BY abs(sessions_change) DESC, current_revenue DESC, "
        f"channel NULLS FIRST) AS rs FROM chan)",
        f"dr0 AS (SELECT *, COALESCE(revenue_change_pct, 0) AS rpct, COALESCE(sessions_change_pct, 0) AS spct, "
        f"{rank_by_rev('demographic')} AS r FROM demo)",
        "dr AS (SELECT *, row_number() OVER (ORDER BY r) AS rk, row_number() OVER (ORDER BY abs(sessions_change) DESC, "
        "current_revenue DESC, demographic NULLS FIRST) AS rs FROM dr0 "
        "WHERE NOT COALESCE(contains(demographic, 'Unknown'), false))",
        f"gr AS (SELECT *, COALESCE(revenue_change_pct, 0) AS rpct, {rank_by_rev('location')} AS r FROM geo)",
    ]
    rel = lambda c, p: f"CASE WHEN {p} > 0 THEN {rnd(cents(f'{c} - {p}'), cents(p), 100, 1)} ELSE 0.0 END"
    exceeds = lambda c, p, thr: f"(CASE WHEN {p} > 0 THEN abs({dec(c)} - {dec(p)}) * 100 > {thr} * {dec(p)} ELSE false END)"
    conv_exceeds = (f"(CASE WHEN c_sessions > 0 AND p_sessions > 0 THEN "
                    f"abs(CAST(c_orders AS HUGEINT) * p_sessions - CAST(p_orders AS HUGEINT) * c_sessions) * 100 "
                    f"> {t.conversion_pp} * c_sessions * p_sessions "
                    f"WHEN c_sessions > 0 THEN c_orders * 100 > {t.conversion_pp} * c_sessions "
                    f"WHEN p_sessions > 0 THEN p_orders * 100 > {t.conversion_pp} * p_sessions ELSE false END)")
    parts = [
        _alert("pv", "total_revenue", "NULL", "'revenue'", f"({dec('c_revenue')} - {dec('p_revenue')})",
               rel("c_revenue", "p_revenue"),
               exceeds("c_revenue", "p_revenue", t.total_revenue_pct)),
        _alert("pv", "bulk_revenue", "NULL", "'bulk_revenue'", f"({dec('c_bulk_revenue')} - {dec('p_bulk_revenue')})",
               rel("c_bulk_revenue", "p_bulk_revenue"),
               f"({exceeds('c_bulk_revenue', 'p_bulk_revenue', t.bulk_revenue_pct)} OR "
               f"abs({dec('c_bulk_revenue')} - {dec('p_bulk_revenue')}) > {t.bulk_revenue_abs})"),
        _alert("pv", "conversion_rate", "NULL", "'conversion_rate'",
               _pp("c_orders", "c_sessions", "p_orders", "p_sessions"), "NULL", conv_exceeds),
        _alert("pr", "product_revenue", "r", "product_name", "revenue_change", "revenue_change_pct",
               f"r <= {n} AND abs(revenue_change) > {t.product_revenue}"),
        _alert("cr", "channel_revenue", "r", "channel", "revenue_change", "rpct",
               f"r <= {n} AND abs(revenue_change) > {t.channel_revenue}"),
        _alert("cr", "channel_sessions", "rs", "channel", "sessions_change", "spct",
               f"rs <= {n} AND abs(sessions_change) > {t.channel_sessions}"),
        _alert("dr", "demographic_revenue", "r", "demographic", "revenue_change", "rpct",
               f"rk <= {n} AND abs(revenue_change) > {t.demographic_revenue}"),
        _alert("dr", "demographic_sessions", "rs", "demographic", "sessions_change", "spct",
               f"rs <= {n} AND abs(sessions_change) > {t.demographic_sessions}"),
        _alert("gr", "top_region", "r", "location", "revenue_change", "rpct",
               f"r = 1 AND abs(revenue_change) > {t.region_revenue}"),
    ]
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


def _covering_base() -> str:
    return f"base AS (SELECT * FROM ev WHERE event_date BETWEEN '{LO}' AND '{HI}')"


def dashboard_sql(null_safe: str) -> str:
    """Breakdowns and bulk items with rank, share and zero-filled percentages, one below the other."""
    def shown(frame: str, src: str, label: str, revenue: str = "current_revenue", more: str = "") -> str:
        cols = more or "previous_revenue, COALESCE(revenue_change_pct, 0) AS revenue_change_pct"
        return (f"SELECT '{frame}' AS frame, {label} AS label, rank, {revenue} AS current_revenue, {cols}, revenue_share "
                f"FROM ({share_select(src, label, revenue)})")

    none = "CAST(NULL AS DOUBLE) AS previous_revenue, CAST(NULL AS DOUBLE) AS revenue_change_pct"
    return with_flat(GEO_BODY, CHANNEL_BODY, null_safe, DEMO_BODY, BULK_BODY) + "\n" + "\nUNION ALL\n".join([
        shown("regions", "geo", "location"), shown("channels", "chan", "channel"), shown("devices", "dev", "device"),
        shown("demographics", "demo", "demographic"), shown("bulk_items", "bulk", "product_name", "item_revenue", none)])


def oracle_sql() -> dict[str, str]:
    base = _covering_base()
    base_items = ("base_items AS (SELECT b.*, i.item_id, i.item_name, i.item_category FROM base b "
                  "JOIN items_x i ON i.order_key = b.event_id WHERE b.has_items)")
    repair = (f"repair AS (SELECT transaction_id FROM base_items WHERE {PURCHASE} "
              f"GROUP BY transaction_id HAVING bool_and({repair_pred()}))")
    null_safe = DEVICE_BODY.replace("ON c.k = p.k", "ON c.k IS NOT DISTINCT FROM p.k")
    filled = lambda src, *cols: (f"\nSELECT * REPLACE ({', '.join(f'COALESCE({c}, 0) AS {c}' for c in cols)}) FROM {src}")
    demo_cols = DEMO_EXPR.split("\n       || ' / ' ||")[0]
    return {
        "q1_kpi_summary": kpi_sql("all"),
        "q2_kpi_summary_store": kpi_sql("store"),
        "q2_kpi_summary_online": kpi_sql("online"),
        "q3_repair_only_orders": with_flat(base, base_items, repair) + "\nSELECT transaction_id FROM repair",
        "q4_session_first_source": with_flat(base, first_source_cte("sfs", "base")) + "\nSELECT * FROM sfs",
        "q5_store_sessions": with_flat(base, first_source_cte("sfs", "base"))
        + f"\nSELECT user_pseudo_id, sid FROM sfs WHERE first_source IN ({STORE_LIST})",
        "q6_trend_daily": trend_sql("daily"),
        "q6_trend_weekly": trend_sql("weekly"),
        "q6_trend_monthly": trend_sql("monthly"),
        "q7_trend_store_daily": trend_sql("daily", "store"),
        "q7_trend_online_weekly": trend_sql("weekly", "online"),
        "q8_trend_conversion": trend_sql("daily", conversion=True),
        "q9_product_performance": with_flat(PRODUCT_BODY) + "\n" + PRODUCT_SELECT,
        "q10_product_post": with_flat(PRODUCT_BODY) + "\n" + PRODUCT_POST_SELECT,
        "q11_channel_performance": with_flat(CHANNEL_BODY) + "\nSELECT * FROM chan",
        "q12_geo_performance": with_flat(GEO_BODY) + "\nSELECT * FROM geo",
        "q13_device_performance": with_flat(DEVICE_BODY) + "\nSELECT * FROM dev",
        "q13_device_performance_null_safe": with_flat(DEVICE_BODY.replace("ON c.k = p.k",
                                                                          "ON c.k IS NOT DISTINCT FROM p.k"))
        + "\nSELECT * FROM dev",
        "j3_geo_outer_join": with_flat(GEO_BODY) + "\nSELECT * FROM geo",
        "j3_device_outer_join": with_flat(DEVICE_BODY) + "\nSELECT * FROM dev",
        "j3_device_outer_join_null_safe": with_flat(DEVICE_BODY.replace("ON c.k = p.k",
                                                                        "ON c.k IS NOT DISTINCT FROM p.k"))
        + "\nSELECT * FROM dev",
        "q14_demographic_performance": with_flat(DEMO_BODY) + "\nSELECT * FROM demo",
        "q15_normalize_demographics": with_flat(DEMO_BASE)
        + f"\nSELECT event_date, user_pseudo_id, sid, event_name, {demo_cols} AS gender, "
          f"COALESCE(NULLIF(a, ''), 'Unknown') AS age, {DEMO_EXPR} AS demographic FROM db",
        "q16_bulk_order_items": with_flat(BULK_BODY) + "\nSELECT * FROM bulk",
        "q17_kpi_derived": kpi_derived_sql(),
        "q18_revenue_share_bulk": with_flat(BULK_BODY) + "\n" + share_select("bulk", "product_name", "item_revenue"),
        "q18_revenue_share_geo": with_flat(GEO_BODY) + "\n" + share_select("geo", "location", "current_revenue"),
        "q18_revenue_share_channel": with_flat(CHANNEL_BODY) + "\n" + share_select("chan", "channel", "current_revenue"),
        "q18_revenue_share_device": with_flat(null_safe) + "\n" + share_select("dev", "device", "current_revenue"),
        "q18_revenue_share_demographic": with_flat(DEMO_BODY) + "\n"
        + share_select("demo", "demographic", "current_revenue"),
        "q11_channel_performance_filled": with_flat(CHANNEL_BODY) + filled("chan", "revenue_change_pct", "sessions_change_pct"),
        "q12_geo_performance_filled": with_flat(GEO_BODY) + filled("geo", "revenue_change_pct"),
        "q13_device_performance_filled": with_flat(null_safe) + filled("dev", "revenue_change_pct"),
        "q14_demographic_performance_filled": with_flat(DEMO_BODY)
        + filled("demo", "revenue_change_pct", "sessions_change_pct"),
        "q19_change_alerts": alerts_sql(),
        "q19_change_alerts_online": alerts_sql("online"),
        "s1_double_money_bulk_items": with_flat(BULK_BODY) + "\nSELECT * FROM bulk",
        "s1_changing_partitions_geo": with_flat(GEO_BODY, flat=FLAT.replace(
            "n.n_name AS city", f"CASE WHEN strftime(e.ts, '%Y%m%d') >= '{CHANGED[0]}' THEN n.n_name END AS city"))
        + "\nSELECT * FROM geo",
        "s1_shards_kpi_summary": kpi_sql("all"),
        "s4_shards_events_per_day": with_flat(base) + "\nSELECT event_date, COUNT(*) AS events FROM base GROUP BY 1",
        "e1_dashboard_breakdowns": dashboard_sql(DEVICE_BODY),
        "e2_labels_geo": with_flat(GEO_BODY) + "\nSELECT * FROM geo",
        "e2_labels_device": with_flat(DEVICE_BODY) + "\nSELECT * FROM dev",
        "e2_labels_demographic": with_flat(DEMO_BODY) + "\nSELECT * FROM demo",
        "w3_rank_uncut_channels": with_flat(CHANNEL_BODY.replace("LIMIT 10", "")) + "\n"
        + share_select("chan", "channel", "current_revenue"),
        "q19_change_alerts_uncut": alerts_sql(),
        "j1_bucketed_first_source": with_flat(base, first_source_cte("sfs", "base")) + "\nSELECT * FROM sfs",
        "a2_bitmap_users": f"SELECT type, users, new_users FROM ({kpi_sql('all')})",
        "r4_approx_counts": f"SELECT type, users, new_users, sessions, true AS hll_near, true AS sketch_near FROM ({kpi_sql('all')})",
        "q2_kpi_summary_store_salted": kpi_sql("store"),
        "r2_grain_kpi_summary": kpi_sql("all"),
        "r2_grain_kpi_summary_store": kpi_sql("store"),
        "r2_grain_kpi_summary_online": kpi_sql("online"),
        "r2_grain_trend_daily": trend_sql("daily"),
        "r2_grain_trend_monthly": trend_sql("monthly"),
        "r2_grain_trend_store_daily": trend_sql("daily", "store"),
        "r2_grain_trend_online_weekly": trend_sql("weekly", "online"),
        "p2_param_lookup": with_flat() .rstrip(",")
        + "\nSELECT event_timestamp, user_pseudo_id, sid, s_num, param_source FROM ev",
        "p3_multi_key_lookup": with_flat().rstrip(",")
        + "\nSELECT event_timestamp, user_pseudo_id, ep_gender, up_gender, ep_age, up_age FROM ev",
        "r1_not_in_null_aware": with_flat(base, base_items, repair)
        + f"\nSELECT event_timestamp, transaction_id, COALESCE(transaction_id NOT IN "
          f"(SELECT transaction_id FROM repair), false) AS kept FROM base WHERE {PURCHASE}",
        "s1_events_per_day": with_flat(base) + "\nSELECT event_date, COUNT(*) AS events FROM base GROUP BY 1",
        "f1_f4_date_buckets": with_flat(base, "days AS (SELECT DISTINCT event_date, "
                                        "CAST(strptime(event_date, '%Y%m%d') AS DATE) AS d FROM base)")
        + "\nSELECT event_date, " + ", ".join(f"CAST({GRAIN_SQL[g]} AS VARCHAR) AS {g}_label"
                                               for g in ("daily", "weekly", "monthly")) + " FROM days",
        "a11_latest_item_names": with_flat(PRODUCT_BODY.split(",\nm AS (")[0]) + "\nSELECT * FROM names",
        "j5_purchase_items": with_flat() .rstrip(",")
        + f"\nSELECT event_timestamp, transaction_id, item_id, item_name, CAST(price AS DOUBLE) AS price, quantity "
          f"FROM ev_items "
          f"WHERE {IN_C} AND {PURCHASE}",
        "w2_session_channels": with_flat(CHANNEL_BODY)
        + "\nSELECT DISTINCT user_pseudo_id, sid, channel FROM in_channel",
    }
