"""Shared pieces of the DuckDB statements the queries are checked against.

The statements say what each result means in the plainest form: events joined to the
snapshot grid, windows over whole clients. The Spark side never runs them.
"""

from __future__ import annotations

from ..params import Params

# the test log covers 30 days, so every horizon is shorter than its default
STORE = Params(
    burst_seconds=86_400,
    left_censor_days=2,
    right_censor_days=3,
    grid_lead_days=7,
    grid_trail_days=7,
    grid_step_days=3,
    activity_days=7,
    purchase_windows=(2, 4, 7),
    label_days=(3, 7),
    category_min_customers=10,
    retention_days=(2, 4, 7),
    recent_days=3,
    declining_days=6,
    at_risk_days=12,
    return_gap_days=6,
    fast_removal_seconds=259_200,
    high_intent_visits=3,
    recent_buyer_days=3,
    split_sizes=(4, 1, 1),
)

# six years of orders; limits follow from their gaps (1.5 medians, 3 medians, p90)
ORDERS = Params(
    retention_days=(90, 180, 365),
    recent_days=230,
    declining_days=459,
    at_risk_days=498,
    return_gap_days=459,
    recent_buyer_days=180,
    grid_lead_days=365,
    grid_trail_days=365,
    grid_step_days=182,
)


def t(col: str, name: str | None = None) -> str:
    return f"CAST({col} AS VARCHAR) AS {name or col.split('.')[-1]}"


def d(col: str, name: str | None = None) -> str:
    return f"CAST(CAST({col} AS DATE) AS VARCHAR) AS {name or col.split('.')[-1]}"


def r(expr: str, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name or expr.split('.')[-1]}"


def i(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr.split('.')[-1]}"


_SOURCES = {
    "ev": r"""
        SELECT user_id * 20 + CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) // 5 AS client_id,
               ts AS event_ts,
               CASE event_type WHEN 'view' THEN 'page_visit' WHEN 'click' THEN 'search_query'
                    WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'remove_from_cart'
                    ELSE 'product_buy' END AS event_type,
               CAST(floor(value / 10) AS BIGINT) AS sku,
               CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k
        FROM events""",
    "buys": "SELECT client_id, event_ts, sku FROM ev WHERE event_type = 'product_buy'",
    "adds": "SELECT client_id, event_ts, sku FROM ev WHERE event_type = 'add_to_cart'",
    "removes": "SELECT client_id, event_ts, sku FROM ev WHERE event_type = 'remove_from_cart'",
    "visits": "SELECT client_id, event_ts, k AS url FROM ev WHERE event_type = 'page_visit'",
    "searches": "SELECT client_id, event_ts, CAST(k AS VARCHAR) AS query FROM ev WHERE event_type = 'search_query'",
    "prod": r"""
        SELECT p_partkey AS sku, CAST(regexp_extract(p_brand, '(\d+)', 1) AS BIGINT) AS category,
               CAST((p_size - 1) * 2 AS BIGINT) AS price_bucket, p_name AS name_embedding
        FROM part""",
    "edge": "SELECT min(event_ts) AS lo, max(event_ts) AS hi FROM ev",
}

_ORDER_SOURCES = {
    "buys": """
        SELECT o_custkey AS client_id, o_orderdate AS event_ts, l_partkey AS sku
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "ev": "SELECT client_id, event_ts, 'product_buy' AS event_type, sku FROM buys",
    "prod": _SOURCES["prod"],
    "edge": _SOURCES["edge"],
}


def _facts(p: Params) -> dict[str, str]:
    return {
        "occ": "SELECT DISTINCT client_id, event_ts FROM buys WHERE event_ts IS NOT NULL",
        "occ_gap": """
            SELECT client_id, event_ts,
                   row_number() OVER c AS seq,
                   date_diff('day', lag(event_ts) OVER c, event_ts) AS gap
            FROM occ WINDOW c AS (PARTITION BY client_id ORDER BY event_ts)""",
        "gaps": """
            SELECT b.*, g.avg_gap, g.sd_gap, g.min_gap, g.max_gap, g.n_occ, g.first_gap
            FROM (SELECT client_id, count(*) AS n_purchases, count(DISTINCT CAST(event_ts AS DATE)) AS n_days,
                         min(event_ts) AS first_ts, max(event_ts) AS last_ts
                  FROM buys GROUP BY 1) b
            LEFT JOIN (SELECT client_id, avg(gap) AS avg_gap, stddev_samp(gap) AS sd_gap, min(gap) AS min_gap,
                              max(gap) AS max_gap, count(*) AS n_occ, min(gap) FILTER (seq = 2) AS first_gap
                       FROM occ_gap GROUP BY 1) g USING (client_id)""",
        "last_gap": "SELECT client_id, arg_max(coalesce(gap, -1), seq) AS last_gap FROM occ_gap GROUP BY 1",
        "cat_occ": "SELECT DISTINCT client_id, category, event_ts FROM occ JOIN buys USING (client_id, event_ts) JOIN prod USING (sku)",
        "cats": """
            SELECT client_id, category, count(*) AS n_purchases, count(DISTINCT sku) AS n_sku,
                   min(event_ts) AS first_ts, max(event_ts) AS last_ts
            FROM buys JOIN prod USING (sku) GROUP BY 1, 2""",
        "obs": f"""
            SELECT client_id, min(event_ts) AS first_ts, max(event_ts) AS last_ts,
                   date_diff('day', min(event_ts), max(event_ts)) AS obs_days,
                   count(DISTINCT CAST(event_ts AS DATE)) AS active_days,
                   min(event_ts) < (SELECT lo FROM edge) + INTERVAL {p.left_censor_days} DAY AS left_c,
                   min(event_ts) >= (SELECT hi FROM edge) - INTERVAL {p.right_censor_days} DAY AS right_c
            FROM ev GROUP BY 1""",
        "grid": f"""
            SELECT CAST(x AS DATE) AS s
            FROM (SELECT unnest(generate_series(CAST(lo AS DATE) + INTERVAL {p.grid_lead_days} DAY,
                                                CAST(hi AS DATE) - INTERVAL {p.grid_trail_days} DAY,
                                                INTERVAL {p.grid_step_days} DAY)) AS x FROM edge)""",
        "cat_rate": f"""
            SELECT s, category, count(*) AS n, sum(CAST(k >= 2 AS INT)) AS n_rep, avg(CAST(k >= 2 AS INT)) AS rate
            FROM (SELECT s, client_id, category, count(*) AS k FROM cat_occ JOIN grid ON event_ts < s GROUP BY 1, 2, 3)
            GROUP BY 1, 2 HAVING count(*) >= {p.category_min_customers}""",
        "cat_avg": """
            SELECT x.s, x.client_id, avg(rate) AS avg_rate
            FROM (SELECT DISTINCT s, client_id, category FROM cat_occ JOIN grid ON event_ts < s) x
            LEFT JOIN cat_rate y ON x.s = y.s AND x.category = y.category
            GROUP BY 1, 2""",
        "cohort": "SELECT *, CAST(date_trunc('week', first_ts) AS DATE) AS cohort_week FROM gaps",
    }


def _store_facts(p: Params) -> dict[str, str]:
    a = p.activity_days
    windows = "".join(
        f", count(*) FILTER (event_ts >= s - INTERVAL {n} DAY) AS n_purchases_{n}d" for n in p.purchase_windows
    )
    labels = "".join(
        f", coalesce(bool_or(event_ts > s AND event_ts <= s + INTERVAL {n} DAY), false)::INT AS label_{n}"
        for n in p.label_days
    )
    recent = ", ".join(
        f"count(*) FILTER (event_type = '{k}' AND event_ts >= s - INTERVAL {a} DAY) AS n_{k}_{a}d"
        for k in ("page_visit", "search_query", "add_to_cart", "remove_from_cart")
    )
    return {
        "pair_add": "SELECT client_id, sku, min(event_ts) AS add_ts FROM adds GROUP BY 1, 2",
        "pair_buy": "SELECT client_id, sku, min(event_ts) AS buy_ts FROM buys GROUP BY 1, 2",
        "pair_removed": """
            SELECT client_id, sku, add_ts, min(event_ts) AS remove_ts
            FROM pair_add JOIN removes USING (client_id, sku) WHERE event_ts >= add_ts GROUP BY 1, 2, 3""",
        "cart": """
            WITH a AS (SELECT client_id, count(*) AS n, count(DISTINCT sku) AS k, min(event_ts) AS f, max(event_ts) AS l
                       FROM adds GROUP BY 1),
                 m AS (SELECT client_id, count(*) AS n, count(DISTINCT sku) AS k, min(event_ts) AS f, max(event_ts) AS l
                       FROM removes GROUP BY 1),
                 c AS (SELECT client_id, count(*) AS n, avg(date_diff('second', add_ts, buy_ts) / 3600.0) AS h
                       FROM pair_add JOIN pair_buy USING (client_id, sku) WHERE buy_ts >= add_ts GROUP BY 1),
                 g AS (SELECT client_id, median(date_diff('second', add_ts, remove_ts)) AS s FROM pair_removed GROUP BY 1)
            SELECT client_id, coalesce(a.n, 0) AS n_add, coalesce(a.k, 0) AS n_add_sku, a.f AS first_add, a.l AS last_add,
                   coalesce(m.n, 0) AS n_remove, coalesce(m.k, 0) AS n_remove_sku, m.f AS first_remove,
                   m.l AS last_remove, coalesce(c.n, 0) AS n_pairs, c.h AS hours, g.s AS removal_secs
            FROM a FULL JOIN m USING (client_id) LEFT JOIN c USING (client_id) LEFT JOIN g USING (client_id)""",
        "daily": """
            SELECT client_id, CAST(event_ts AS DATE) AS activity_date,
                   count(*) FILTER (event_type = 'page_visit') AS n_page_visit,
                   count(*) FILTER (event_type = 'search_query') AS n_search_query,
                   count(*) FILTER (event_type = 'add_to_cart') AS n_add_to_cart,
                   count(*) FILTER (event_type = 'remove_from_cart') AS n_remove_from_cart,
                   count(*) FILTER (event_type = 'product_buy') AS n_product_buy,
                   count(*) AS n_events_total, count(DISTINCT event_type) AS n_event_types_active
            FROM ev GROUP BY 1, 2""",
        "firsts": """
            SELECT client_id, min(event_ts) FILTER (event_type = 'page_visit') AS first_visit,
                   min(event_ts) FILTER (event_type = 'search_query') AS first_search,
                   count(*) FILTER (event_type = 'page_visit') AS n_visit,
                   count(*) FILTER (event_type = 'search_query') AS n_search
            FROM ev GROUP BY 1""",
        "c360": """
            SELECT o.*, f.n_visit, f.n_search, f.first_visit, f.first_search,
                   coalesce(c.n_add, 0) AS n_add, coalesce(c.n_remove, 0) AS n_remove,
                   coalesce(g.n_purchases, 0) AS n_purchases, coalesce(g.n_days, 0) AS n_purchase_days,
                   g.first_ts AS first_buy, g.last_ts AS last_buy, g.avg_gap,
                   g.client_id IS NOT NULL AS is_buyer, c.client_id IS NOT NULL AS has_cart,
                   coalesce(g.n_days, 0) >= 2 AS is_repeat, c.removal_secs
            FROM obs o JOIN firsts f USING (client_id) LEFT JOIN cart c USING (client_id) LEFT JOIN gaps g USING (client_id)""",
        "life": f"""
            SELECT *, CASE
                WHEN since <= {p.recent_days} AND n_purchase_days = 1 THEN 'first_purchase'
                WHEN since <= {p.recent_days} AND last_gap > {p.return_gap_days} THEN 'returned'
                WHEN since <= {p.recent_days} THEN 'active'
                WHEN since <= {p.declining_days} THEN 'declining'
                WHEN since <= {p.at_risk_days} THEN 'at_risk'
                WHEN since IS NOT NULL THEN 'inactive'
                WHEN has_cart THEN 'cart'
                WHEN n_visit + n_search > 0 THEN 'explorer' ELSE 'other' END AS stage
            FROM (SELECT c.*, date_diff('day', last_buy, (SELECT hi FROM edge)) AS since,
                         nullif(l.last_gap, -1) AS last_gap
                  FROM c360 c LEFT JOIN last_gap l USING (client_id))""",
        "seg": f"""
            SELECT *, CASE WHEN stage = 'cart' THEN
                       CASE WHEN removal_secs IS NULL THEN 'no_removal_recorded'
                            WHEN removal_secs <= {p.fast_removal_seconds} THEN 'fast_removal'
                            ELSE 'slow_removal' END END AS subtype,
                   CASE stage
                     WHEN 'explorer' THEN CASE WHEN n_visit >= {p.high_intent_visits} OR first_search < first_visit
                                               THEN 'high_intent_explorer' ELSE 'low_intent_explorer' END
                     WHEN 'cart' THEN CASE WHEN removal_secs IS NULL THEN 'cart_hold' ELSE 'cart_abandon' END
                     WHEN 'active' THEN 'steady_repeat' WHEN 'declining' THEN 'declining_repeat'
                     WHEN 'at_risk' THEN 'lapsed' WHEN 'inactive' THEN 'lapsed' ELSE stage END AS segment
            FROM life""",
        "past": f"""
            SELECT s, client_id, max(event_ts) AS last_ts, count(*) AS n_occ,
                   count(DISTINCT CAST(event_ts AS DATE)) AS n_days, avg(gap) AS avg_gap{windows}
            FROM occ_gap JOIN grid ON event_ts < s GROUP BY 1, 2""",
        "recent": f"""
            SELECT s, client_id, {recent},
                   count(*) FILTER (event_type = 'page_visit') AS cum_visits,
                   count(*) FILTER (event_type = 'add_to_cart') AS cum_adds,
                   min(event_ts) FILTER (event_type = 'page_visit') AS fv,
                   min(event_ts) FILTER (event_type = 'search_query') AS fs
            FROM ev JOIN grid ON event_ts < s GROUP BY 1, 2""",
        "ahead": f"""
            SELECT s, client_id{labels}
            FROM (SELECT s, client_id FROM recent) JOIN grid USING (s) LEFT JOIN occ USING (client_id)
            GROUP BY 1, 2""",
        "n_cat": """
            SELECT s, client_id, count(DISTINCT category) AS n_categories
            FROM cat_occ JOIN grid ON event_ts < s GROUP BY 1, 2""",
        "snap": f"""
            SELECT p.*, date_diff('day', p.last_ts, p.s) AS since, coalesce(n_categories, 0) AS n_categories,
                   avg_rate, r.* EXCLUDE (s, client_id), h.* EXCLUDE (s, client_id)
            FROM past p JOIN recent r USING (s, client_id) JOIN ahead h USING (s, client_id)
            LEFT JOIN n_cat USING (s, client_id) LEFT JOIN cat_avg USING (s, client_id)""",
        "prop": f"""
            SELECT r.*, p.client_id IS NOT NULL AS has_history, p.last_ts, date_diff('day', p.last_ts, s) AS since,
                   coalesce(p.n_occ, 0) AS n_occ, avg_rate, h.* EXCLUDE (s, client_id)
            FROM recent r LEFT JOIN past p USING (s, client_id) JOIN ahead h USING (s, client_id)
            LEFT JOIN cat_avg USING (s, client_id)
            WHERE cum_visits >= {p.high_intent_visits} OR fs < fv OR cum_adds > 0 OR p.client_id IS NOT NULL""",
    }


def store_sql(body: str, extra: dict[str, str] | None = None, p: Params = STORE) -> str:
    return _with({**_SOURCES, **_facts(p), **_store_facts(p), **(extra or {})}, body)


def orders_sql(body: str, p: Params = ORDERS) -> str:
    return _with({**_ORDER_SOURCES, **_facts(p)}, body)


def _with(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body
