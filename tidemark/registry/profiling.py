"""Profiles and data-quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..operators import profile
from ..plans.rollup import EVENT_TYPES
from ..sources.streams import from_event_table, products_from_parts, purchases_from_orders
from .base import Registry
from .sql import ORDERS, STORE, d, orders_sql, r, store_sql, t

TABLES = {
    "customer": "c_custkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "events": "event_id",
}
CUTOFF = "2024-01-20"


def long_sql(source: str, metrics: dict[str, str]) -> str:
    rows = "\nUNION ALL ".join(
        f"SELECT '{name}' AS metric, {r(f'({expr})', 'value')} FROM {source}" for name, expr in metrics.items()
    )
    return rows


def register(reg: Registry) -> None:
    P, O = STORE, ORDERS

    def store(fn):
        return lambda spark, sf: fn(from_event_table(spark, sf))

    def orders(fn):
        return lambda spark, sf: fn(purchases_from_orders(spark, sf))

    # --- tables ----------------------------------------------------------------------
    columns = {
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    }

    def profiles(spark, sf):
        parts = [
            profile.table_profile(spark.read.parquet(f"{sf}/{name}.parquet").select(*cols), name).drop("data_type")
            for name, cols in columns.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    reg.add(
        "q01_table_profile",
        profiles,
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) AS n_rows,
                count(*) - count({c}) AS n_null, {r(f'(count(*) - count({c})) / count(*)', 'null_pct')},
                count(DISTINCT {c}) AS n_distinct FROM {name}"""
            for name, cols in columns.items()
            for c in cols
        ),
    )
    reg.add(
        "q02_duplicated_rows",
        lambda spark, sf: profile.duplicated_rows(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber")),
        """SELECT count(*) AS n_duplicated_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows_in_duplicates
           FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""",
    )
    reg.add(
        "q02_duplicated_rows_orders",
        orders(profile.duplicated_rows),
        orders_sql(
            """SELECT count(*) AS n_duplicated_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows_in_duplicates
               FROM (SELECT client_id, event_ts, sku, count(*) AS n FROM buys GROUP BY 1, 2, 3 HAVING count(*) > 1)"""
        ),
    )
    reg.add(
        "q03_key_uniqueness",
        lambda spark, sf: profile.key_uniqueness(
            spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_linenumber"]
        ),
        """SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct_keys,
           count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS is_unique FROM lineitem""",
    )
    for name, last, order in (("q04_head_rows", False, "ASC"), ("q04_tail_rows", True, "DESC")):
        reg.add(
            name,
            lambda spark, sf, last=last: profile.edge_rows(
                spark.read.parquet(f"{sf}/events.parquet"), ["event_id"], last=last
            ),
            f"""SELECT event_id, {t('ts')}, user_id, event_type, {r('value')}, props
                FROM events ORDER BY event_id {order} LIMIT 5""",
        )

    # --- events ----------------------------------------------------------------------
    reg.add(
        "q05_timestamp_audit",
        store(lambda s: profile.timestamp_audit(s.events, CUTOFF)),
        store_sql(
            f"""SELECT event_type, count(*) AS row_count, count(*) - count(event_ts) AS parse_fail_count,
                {t('min(event_ts)', 'min_ts')}, {t('max(event_ts)', 'max_ts')},
                count(DISTINCT client_id) AS unique_clients,
                count(*) FILTER (event_ts >= TIMESTAMP '{CUTOFF}') AS rows_after_cutoff,
                date_sub('day', min(event_ts), max(event_ts)) AS observation_days,
                {r(f"count(*) FILTER (event_ts >= TIMESTAMP '{CUTOFF}') * 100.0 / count(*)", 'pct_after_cutoff')}
                FROM ev GROUP BY 1"""
        ),
    )
    kinds = "SELECT client_id, " + ", ".join(
        f"bool_or(event_type = '{k}') AS {k}" for k in EVENT_TYPES
    ) + " FROM ev GROUP BY 1"
    size = " + ".join(f"{k}::INT" for k in EVENT_TYPES)
    n = {k: f"count(*) FILTER ({k})" for k in EVENT_TYPES}
    pairs = {name: f"count(*) FILTER ({a} AND {b})" for name, (a, b) in profile.PAIRS.items()}
    all5 = f"count(*) FILTER ({size} = 5)"
    reg.add(
        "q06_client_overlap",
        store(lambda s: profile.client_overlap(s.events)),
        store_sql(
            long_sql(
                "kinds",
                {
                    **{f"unique_clients_{k}": n[k] for k in EVENT_TYPES},
                    "total_unique_clients_union": "count(*)",
                    **{f"intersect_{k}": v for k, v in pairs.items()},
                    "clients_with_all_5_events": all5,
                    "clients_with_only_1_event_type": f"count(*) FILTER ({size} = 1)",
                },
            ),
            {"kinds": kinds},
        ),
    )
    reg.add(
        "q06a_client_overlap_shares",
        store(lambda s: profile.client_overlap_shares(s.events)),
        store_sql(
            long_sql(
                "kinds",
                {
                    **{f"pct_clients_{k}": f"{n[k]} * 100.0 / count(*)" for k in EVENT_TYPES},
                    **{f"pct_{k}": f"{v} * 100.0 / {n[profile.PAIRS[k][0]]}" for k, v in pairs.items()},
                    "pct_all_5_of_clients": f"{all5} * 100.0 / count(*)",
                    "pct_all_5_of_buyers": f"{all5} * 100.0 / {n['product_buy']}",
                },
            ),
            {"kinds": kinds},
        ),
    )
    reg.add(
        "q07_event_type_distribution",
        store(lambda s: profile.event_type_distribution(s.events)),
        store_sql(
            f"""SELECT CAST({size} AS BIGINT) AS n_event_types, count(*) AS n_clients,
                {r('count(*) * 100.0 / (SELECT count(*) FROM kinds)', 'pct')} FROM kinds GROUP BY 1""",
            {"kinds": kinds},
        ),
    )
    reg.add(
        "q08_product_match",
        store(profile.product_match),
        store_sql(
            f"""SELECT event_type, count(DISTINCT e.sku) AS n_distinct_sku, count(DISTINCT prod.sku) AS n_matched_sku,
                {r('count(DISTINCT prod.sku) * 100.0 / count(DISTINCT e.sku)', 'match_rate_pct')}
                FROM (SELECT * FROM ev WHERE event_type IN ('product_buy', 'add_to_cart', 'remove_from_cart')) e
                LEFT JOIN prod USING (sku) GROUP BY 1"""
        ),
    )
    null_attrs = {
        f"null_{c}": f"count(*) - count({c})" for c in ("category", "price_bucket", "name_embedding")
    }
    reg.add(
        "q09_product_attributes",
        lambda spark, sf: profile.product_attributes(products_from_parts(spark, sf)),
        store_sql(
            long_sql(
                "prod",
                {
                    "n_rows": "count(*)",
                    "n_distinct_sku": "count(DISTINCT sku)",
                    **null_attrs,
                    **{f"{k}_pct": f"({v}) * 100.0 / count(*)" for k, v in null_attrs.items()},
                    "price_min": "min(price_bucket)",
                    "price_max": "max(price_bucket)",
                    "price_distinct_count": "count(DISTINCT price_bucket)",
                },
            )
            + "\nUNION ALL "
            + long_sql(
                """(SELECT sku, count(*) AS n, count(DISTINCT category) AS c, count(DISTINCT price_bucket) AS b
                    FROM prod GROUP BY 1)""",
                {
                    "sku_with_multiple_rows": "count(*) FILTER (n > 1)",
                    "sku_with_conflicting_attributes": "count(*) FILTER (c > 1 OR b > 1)",
                },
            )
        ),
    )
    per_client = {"per_client": "SELECT event_type, client_id, count(*) AS n FROM ev GROUP BY 1, 2"}
    reg.add(
        "q10_events_per_client",
        store(lambda s: profile.events_per_client_distribution(s.events)),
        store_sql(
            f"""SELECT event_type, min(n) AS min_events_per_client, {r('avg(n)', 'mean_events_per_client')},
                max(n) AS max_events_per_client, {r('quantile_cont(n, 0.5)', 'p50')}, {r('quantile_cont(n, 0.9)', 'p90')},
                {r('quantile_cont(n, 0.95)', 'p95')}, {r('quantile_cont(n, 0.99)', 'p99')},
                {r('quantile_cont(n, 0.999)', 'p999')} FROM per_client GROUP BY 1""",
            per_client,
        ),
    )
    reg.add(
        "q11_heaviest_clients",
        store(lambda s: profile.heaviest_clients(s.events, P)),
        store_sql(
            f"""SELECT event_type, client_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, client_id) AS rank
                FROM per_client QUALIFY rank <= {P.top_clients}""",
            per_client,
        ),
    )
    flagged = "\nUNION ALL ".join(
        f"""SELECT '{kind}' AS event_type, coalesce(date_diff('second', lag(event_ts) OVER (PARTITION BY {part}
            ORDER BY event_ts), event_ts) BETWEEN 0 AND {P.burst_seconds}, false) AS f FROM {table}"""
        for kind, table, part in (
            ("product_buy", "buys", "client_id, sku"),
            ("add_to_cart", "adds", "client_id, sku"),
            ("remove_from_cart", "removes", "client_id, sku"),
            ("page_visit", "visits", "client_id, url"),
            ("search_query", "searches", "client_id"),
        )
    )
    reg.add(
        "q12_burst_rate",
        store(lambda s: profile.burst_rate(s, P)),
        store_sql(
            f"""SELECT event_type, count(*) FILTER (f) AS burst_event_count, count(*) AS total_rows,
                {r('count(*) FILTER (f) * 100.0 / count(*)', 'burst_pct')} FROM ({flagged}) GROUP BY 1"""
        ),
    )
    reg.add(
        "q13_observation_summary",
        store(lambda s: profile.observation_summary(s, P)),
        store_sql(
            f"""SELECT {t('min(first_ts)', 'first_ts_min')}, {t('max(first_ts)', 'first_ts_max')},
                {t('min(last_ts)', 'last_ts_min')}, {t('max(last_ts)', 'last_ts_max')},
                {r('median(active_days)', 'median_active_days')}, {r('avg(active_days)', 'mean_active_days')},
                {r('max(active_days)', 'max_active_days')}, count(*) AS n_clients FROM obs"""
        ),
    )
    reg.add(
        "q14_daily_volume",
        store(lambda s: profile.daily_volume(s.events)),
        store_sql(
            f"""SELECT event_type, count(*) AS n_observed_days, {r('avg(n)', 'mean_daily_count')},
                {r('stddev_samp(n)', 'std_daily_count')}, {d('first(x ORDER BY n DESC, x)', 'max_day')},
                max(n) AS max_day_count, {d('first(x ORDER BY n, x)', 'min_day')}, min(n) AS min_day_count
                FROM (SELECT event_type, CAST(event_ts AS DATE) AS x, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1"""
        ),
    )
    reg.add(
        "q15_observation_distribution",
        store(lambda s: profile.observation_distribution(s, P)),
        store_sql(
            long_sql(
                "obs",
                {
                    "n_clients": "count(*)",
                    "obs_days_min": "min(obs_days)",
                    "obs_days_mean": "avg(obs_days)",
                    "obs_days_median": "median(obs_days)",
                    "obs_days_p90": "quantile_cont(obs_days, 0.9)",
                    "obs_days_p95": "quantile_cont(obs_days, 0.95)",
                    "obs_days_max": "max(obs_days)",
                    "obs_days_zero_count": "count(*) FILTER (obs_days = 0)",
                    "obs_days_zero_pct": "count(*) FILTER (obs_days = 0) * 100.0 / count(*)",
                    "left_censor_candidates": "count(*) FILTER (left_c)",
                    "left_censor_pct": "count(*) FILTER (left_c) * 100.0 / count(*)",
                    "right_censor_candidates": "count(*) FILTER (right_c)",
                    "right_censor_pct": "count(*) FILTER (right_c) * 100.0 / count(*)",
                },
            )
        ),
    )
    early = f"count(*) FILTER (first_ts < (SELECT lo FROM edge) + INTERVAL {P.left_censor_days} DAY)"
    late = f"count(*) FILTER (last_ts >= (SELECT hi FROM edge) - INTERVAL {P.right_censor_days} DAY)"
    reg.add(
        "q16_buyer_censoring",
        store(lambda s: profile.buyer_censoring(s, P)),
        store_sql(
            long_sql(
                "gaps",
                {
                    "n_buyers": "count(*)",
                    "buyers_first_purchase_in_left_window": early,
                    "buyers_last_purchase_in_right_window": late,
                    "left_window_pct": f"{early} * 100.0 / count(*)",
                    "right_window_pct": f"{late} * 100.0 / count(*)",
                },
            )
        ),
    )

    # --- purchases, carts, searches -----------------------------------------------------
    buyer = """(SELECT client_id, count(*) AS purchases, count(DISTINCT CAST(event_ts AS DATE)) AS purchase_days,
                count(DISTINCT sku) AS unique_skus, count(DISTINCT category) AS categories
                FROM buys LEFT JOIN prod USING (sku) GROUP BY 1)"""
    buyer_metrics = {}
    for c in ("purchases", "purchase_days", "unique_skus", "categories"):
        buyer_metrics |= {f"mean_{c}": f"avg({c})", f"median_{c}": f"median({c})"}
    buyer_metrics |= {
        "buyer_count": "count(*)",
        "pct_1_purchase_day": "count(*) FILTER (purchase_days = 1) * 100.0 / count(*)",
        "pct_2plus_purchase_days": "count(*) FILTER (purchase_days >= 2) * 100.0 / count(*)",
        "pct_3plus_purchase_days": "count(*) FILTER (purchase_days >= 3) * 100.0 / count(*)",
        "repeat_capable_customers": "count(*) FILTER (purchase_days >= 2)",
    }
    reg.add(
        "q17_buyer_summary",
        store(lambda s: profile.buyer_summary(s.buy, s.products)),
        store_sql(long_sql(buyer, buyer_metrics)),
    )
    reg.add(
        "q17_buyer_summary_orders",
        lambda spark, sf: profile.buyer_summary(purchases_from_orders(spark, sf), products_from_parts(spark, sf)),
        orders_sql(long_sql(buyer, buyer_metrics)),
    )

    def recent_sql(p):
        hit = f"count(*) FILTER (last_ts >= (SELECT max(event_ts) FROM buys) - INTERVAL {p.recent_buyer_days} DAY)"
        return f"""SELECT count(*) AS n_buyers, {hit} AS n_recent_buyers,
            {r(f'{hit} * 100.0 / count(*)', 'pct_recent_buyers')} FROM gaps"""

    reg.add("q18_recent_buyers", store(lambda s: profile.recent_buyers(s.buy, P)), store_sql(recent_sql(P)))
    reg.add("q18_recent_buyers_orders", orders(lambda b: profile.recent_buyers(b, O)), orders_sql(recent_sql(O)))
    gap_days = """(SELECT date_diff('second', lag(event_ts) OVER (PARTITION BY client_id ORDER BY event_ts), event_ts)
                   / 86400.0 AS g FROM occ)"""
    gap_sql = f"""SELECT count(g) AS n_gaps, {r('avg(g)', 'gap_mean_days')}, """ + ", ".join(
        r(f"quantile_cont(g, {q / 100})", f"gap_p{q}_days") for q in (25, 50, 75, 90, 95)
    ) + f" FROM {gap_days}"
    reg.add("q19_purchase_gap_days", store(lambda s: profile.purchase_gap_distribution(s.buy)), store_sql(gap_sql))
    reg.add("q19_purchase_gap_days_orders", orders(profile.purchase_gap_distribution), orders_sql(gap_sql))
    reg.add(
        "q20_cart_counts",
        store(profile.cart_counts),
        store_sql(
            f"""SELECT event_type, count(*) AS n_clients, {r('avg(n)', 'mean_per_client')},
                {r('median(n)', 'median_per_client')} FROM per_client
                WHERE event_type IN ('add_to_cart', 'remove_from_cart') GROUP BY 1""",
            per_client,
        ),
    )
    reg.add(
        "q21_top_cart_items",
        store(lambda s: profile.top_cart_items(s, P)),
        store_sql(
            f"""SELECT rank, a.sku AS added_sku, a.n AS n_added, m.sku AS removed_sku, m.n AS n_removed FROM
                (SELECT sku, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sku) AS rank FROM adds GROUP BY 1) a
                FULL JOIN
                (SELECT sku, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sku) AS rank FROM removes GROUP BY 1) m
                USING (rank) WHERE rank <= {P.top_items}"""
        ),
    )
    reg.add(
        "q22_add_to_buy",
        store(profile.add_to_buy),
        store_sql(
            f"""SELECT count(h) AS matched_pairs, count(*) AS total_pairs, {r('count(h) * 100.0 / count(*)', 'conversion_pct')},
                {r('avg(h)', 'mean_hours')}, {r('median(h)', 'median_hours')}, {r('quantile_cont(h, 0.9)', 'p90_hours')}
                FROM (SELECT CASE WHEN buy_ts >= add_ts THEN date_diff('second', add_ts, buy_ts) / 3600.0 END AS h
                      FROM pair_add LEFT JOIN pair_buy USING (client_id, sku))"""
        ),
    )
    reg.add(
        "q23_remove_then_buy",
        store(profile.remove_then_buy),
        store_sql(
            f"""SELECT count(*) FILTER (buy_ts >= remove_ts) AS remove_then_buy_pairs, count(*) AS remove_total_pairs,
                {r('count(*) FILTER (buy_ts >= remove_ts) * 100.0 / count(*)', 'remove_then_buy_pct')}
                FROM (SELECT client_id, sku, min(event_ts) AS remove_ts FROM removes GROUP BY 1, 2)
                LEFT JOIN pair_buy USING (client_id, sku)"""
        ),
    )

    def browsing_sql(rows):
        return f"""SELECT event_type, count(*) AS n_clients, {r('avg(n)', 'mean_per_client')},
            {r('median(n)', 'median_per_client')} FROM ({rows}) GROUP BY 1"""

    reg.add(
        "q24_pre_purchase_browsing",
        store(profile.pre_purchase_browsing),
        store_sql(
            browsing_sql(
                """SELECT event_type, client_id, count(*) AS n FROM ev JOIN gaps USING (client_id)
                   WHERE event_type IN ('page_visit', 'search_query') AND event_ts < first_ts GROUP BY 1, 2"""
            )
        ),
    )
    reg.add(
        "q25_non_buyer_browsing",
        store(profile.non_buyer_browsing),
        store_sql(
            browsing_sql(
                """SELECT event_type, client_id, count(*) AS n FROM ev ANTI JOIN gaps USING (client_id)
                   WHERE event_type IN ('page_visit', 'search_query') GROUP BY 1, 2"""
            )
        ),
    )
    same_sql = f"""SELECT count(prev) AS consecutive_rows, count(*) FILTER (prev = event_ts) AS same_ts_rows,
        {r('count(*) FILTER (prev = event_ts) * 100.0 / count(prev)', 'same_ts_pct')},
        {r("avg(date_diff('second', prev, event_ts) / 86400.0)", 'row_gap_mean_days')},
        {r("avg(date_diff('second', prev, event_ts) / 86400.0) FILTER (prev <> event_ts)", 'occasion_gap_mean_days')}
        FROM (SELECT event_ts, lag(event_ts) OVER (PARTITION BY client_id ORDER BY event_ts) AS prev FROM buys)"""
    reg.add("q26_same_timestamp_share", store(lambda s: profile.same_timestamp_share(s.buy)), store_sql(same_sql))
    reg.add("q26_same_timestamp_share_orders", orders(profile.same_timestamp_share), orders_sql(same_sql))
