"""Funnel, segment, distribution and report-fact queries."""

from __future__ import annotations

from ..operators import facts, marts, metrics, panel, reports
from ..sources.streams import from_event_table, purchases_from_orders
from .base import Registry
from .profiling import long_sql
from .scoring import METRIC_CTES, churn_scored
from .sql import ORDERS, STORE, d, orders_sql, r, store_sql

# the prose of the test documents is invented; these strings do occur in it
TEST_PHRASES = ("guaranteed", "heren", "nicht", "password", "tion the", "thion")


def register(reg: Registry) -> None:
    P = STORE

    def store(fn):
        return lambda spark, sf: fn(from_event_table(spark, sf))

    def customers(fn):
        return store(lambda s: fn(marts.customer_360(s, P)))

    explore = "(n_visit > 0 OR n_search > 0)"

    # --- funnel ----------------------------------------------------------------------
    reg.add(
        "f01_funnel_reach",
        customers(reports.funnel_reach),
        store_sql(
            f"""SELECT step, stage, n_customers, {r('n_customers * 100.0 / first_value(n_customers) OVER (ORDER BY step)', 'pct_of_total')},
                {r('CASE WHEN step > 2 THEN n_customers * 100.0 / lag(n_customers) OVER (ORDER BY step) END', 'pct_of_prev_stage')}
                FROM (SELECT 1 AS step, 'all_customers' AS stage, count(*) AS n_customers FROM c360
                      UNION ALL SELECT 2, 'explore', count(*) FROM c360 WHERE {explore}
                      UNION ALL SELECT 3, 'explore_cart', count(*) FROM c360 WHERE {explore} AND has_cart
                      UNION ALL SELECT 4, 'explore_cart_buy', count(*) FROM c360 WHERE {explore} AND has_cart AND is_buyer)"""
        ),
    )
    reg.add(
        "f02_buyer_paths",
        customers(reports.buyer_paths),
        store_sql(
            f"""SELECT {explore} AS has_explore, has_cart, is_buyer, count(*) AS n_customers,
                {r('CASE WHEN is_buyer THEN count(*) * 100.0 / (SELECT count(*) FROM c360 WHERE is_buyer) END', 'pct_of_buyers')}
                FROM c360 GROUP BY 1, 2, 3"""
        ),
    )
    reg.add(
        "f03_repeat_vs_single",
        customers(reports.repeat_vs_single),
        store_sql(
            """SELECT CASE WHEN n_purchase_days = 1 THEN 'one_purchase_day' ELSE 'two_or_more_days' END AS group_name,
               count(*) AS n_customers FROM c360 WHERE is_buyer GROUP BY 1"""
        ),
    )
    first_label = min(P.label_days)
    kpi_metrics = {
        "total_customers": "count(*)",
        "buyers": "count(*) FILTER (is_buyer)",
        "repeat_buyers": "count(*) FILTER (is_repeat)",
        "cart_customers": "count(*) FILTER (has_cart)",
        "at_risk_customers": "count(*) FILTER (stage = 'at_risk')",
        "inactive_customers": "count(*) FILTER (stage = 'inactive')",
        "recent_converters": f"max((SELECT sum(label_{first_label}) FROM prop WHERE s = (SELECT max(s) FROM prop)))",
    }
    reg.add(
        "f04_overview_kpis",
        store(lambda s: reports.overview_kpis(s, panel.purchase_propensity(s, P), P)),
        store_sql(long_sql("life", kpi_metrics)),
    )
    funnel = {
        "total": "count(*)",
        "explore": f"count(*) FILTER ({explore})",
        "cart": "count(*) FILTER (has_cart)",
        "buy": "count(*) FILTER (is_buyer)",
        "explore_to_cart": f"count(*) FILTER ({explore} AND has_cart)",
        "cart_to_buy": "count(*) FILTER (has_cart AND is_buyer)",
        "buy_with_no_footprint": f"count(*) FILTER (is_buyer AND NOT has_cart AND NOT {explore})",
    }
    reg.add(
        "f05_funnel_summary",
        customers(reports.funnel_summary),
        store_sql(f"SELECT metric AS stage_metric, value FROM ({long_sql('c360', funnel)})"),
    )

    def share(a, b):
        return f"{funnel[a]} * 100.0 / nullif({funnel[b]}, 0)"

    reg.add(
        "f05a_stage_rates",
        customers(reports.stage_rates),
        store_sql(
            long_sql(
                "c360",
                {
                    "explore_pct_of_total": share("explore", "total"),
                    "cart_pct_of_total": share("cart", "total"),
                    "buy_pct_of_total": share("buy", "total"),
                    "cart_pct_of_explore_stage": share("cart", "explore"),
                    "buy_pct_of_cart_stage": share("buy", "cart"),
                    "explore_to_cart_rate": share("explore_to_cart", "explore"),
                    "cart_to_buy_rate": share("cart_to_buy", "cart"),
                    "no_footprint_pct_of_buyers": share("buy_with_no_footprint", "buy"),
                },
            )
        ),
    )

    # --- stages and segments ---------------------------------------------------------
    def dist_sql(column, source, name):
        return f"""SELECT {column} AS {name}, count(*) AS n,
            round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM {source} GROUP BY 1"""

    reg.add(
        "f06_stage_distribution",
        store(lambda s: reports.distribution(marts.customer_lifecycle(s, P), "lifecycle_stage")),
        store_sql(dist_sql("stage", "life", "lifecycle_stage")),
    )
    reg.add(
        "f06_segment_distribution",
        store(lambda s: reports.distribution(marts.customer_segment(s, P), "segment")),
        store_sql(dist_sql("segment", "seg", "segment")),
    )
    profile_cols = f"""segment, count(*) AS n, {r('avg(is_buyer::INT)', 'buy_rate')}, {r('avg(n_visit)', 'avg_visit')},
        {r('avg(n_search)', 'avg_search')}, {r('avg(n_purchases)', 'avg_purchases')}, {r('avg(avg_gap)', 'avg_gap_days')}"""
    reg.add(
        "f07_segment_profile",
        store(lambda s: reports.segment_profile(s, P)),
        store_sql(f"SELECT {profile_cols} FROM seg GROUP BY segment"),
    )
    notes = ", ".join(str(n) for n in reports.SEGMENT_NOTES)
    note_cte = {
        "notes": f"""SELECT * FROM (VALUES {notes})
                     AS v(segment, crm_purpose, recommended_action, priority, over_contact_risk)"""
    }
    reg.add(
        "f08_segment_notes",
        store(lambda s: reports.with_segment_notes(reports.segment_profile(s, P))),
        store_sql(
            f"SELECT * FROM (SELECT {profile_cols} FROM seg GROUP BY segment) LEFT JOIN notes USING (segment)", note_cte
        ),
    )

    def rank_sql(column, ranks, default):
        return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + f" ELSE {default} END"

    pr = rank_sql("priority", reports.PRIORITY_RANK, 0)
    cr = rank_sql("over_contact_risk", reports.CONTACT_RISK_RANK, 99)
    reg.add(
        "f09_action_list",
        store(lambda s: reports.action_list(reports.segment_profile(s, P))),
        store_sql(
            f"""SELECT row_number() OVER (ORDER BY {pr} DESC, {cr}, segment) AS position, segment, n, priority,
                {pr} AS priority_rank, over_contact_risk, {cr} AS over_contact_rank, recommended_action
                FROM (SELECT segment, count(*) AS n FROM seg GROUP BY 1) LEFT JOIN notes USING (segment)""",
            note_cte,
        ),
    )
    tone = rank_sql("stage", {k: f"'{v}'" for k, v in reports.STAGE_TONE.items()}, "'neutral'")
    reg.add(
        "f10_stage_groups",
        store(lambda s: reports.stage_groups(marts.customer_lifecycle(s, P))),
        store_sql(dist_sql(tone, "life", "tone")),
    )

    def kept_sql(p):
        backs = {
            n: f"""coalesce((SELECT min(o.event_ts) FROM occ o WHERE o.client_id = c.client_id AND o.event_ts > c.first_ts)
                <= c.first_ts + INTERVAL {n} DAY, false)::INT AS back_{n}"""
            for n in p.retention_days
        }
        rates = ", ".join(f"avg(back_{n}) AS rate_{n}" for n in p.retention_days)
        means = ", ".join(r(f"avg(rate_{n})", f"mean_repurchase_{n}d_rate") for n in p.retention_days)
        return f"""SELECT count(*) AS n_cohorts, {means} FROM (
            SELECT cohort_week, {rates} FROM (SELECT cohort_week, {', '.join(backs.values())} FROM cohort c) GROUP BY 1)
            WHERE cohort_week + INTERVAL {max(p.retention_days)} DAY <= (SELECT hi FROM edge)"""

    reg.add(
        "f11_uncensored_retention",
        store(lambda s: reports.uncensored_retention(marts.customer_retention(s, P), P)),
        store_sql(kept_sql(P)),
    )
    reg.add(
        "f16_cart_split",
        store(lambda s: reports.cart_split(marts.customer_segment(s, P))),
        store_sql(
            dist_sql(
                """CASE WHEN segment = 'cart_hold' THEN 'hold' WHEN subtype = 'fast_removal' THEN 'abandon_fast'
                   ELSE 'abandon_slow' END""",
                "(SELECT * FROM seg WHERE segment IN ('cart_hold', 'cart_abandon'))",
                "cart_group",
            )
        ),
    )

    # --- distributions ---------------------------------------------------------------
    reg.add(
        "f12_daily_event_volume",
        store(lambda s: reports.daily_event_volume(facts.daily_activity(s))),
        store_sql(
            f"""SELECT {d('event_ts', 'activity_date')}, """
            + ", ".join(
                f"count(*) FILTER (event_type = '{k}') AS {k}"
                for k in ("page_visit", "search_query", "add_to_cart", "remove_from_cart", "product_buy")
            )
            + " FROM ev GROUP BY 1"
        ),
    )
    reg.add(
        "f13_event_count_histogram",
        customers(reports.event_count_histogram),
        store_sql(
            f"""SELECT bin, {r('pow(10.0, top * bin / 59)', 'lower_edge')}, {r('pow(10.0, top * (bin + 1) / 59)', 'upper_edge')},
                n_clients FROM (
                SELECT CAST(least(floor(log10(x) / top * 59), 58) AS BIGINT) AS bin, top, count(*) AS n_clients
                FROM (SELECT n_visit + n_search + n_add + n_purchases AS x,
                             max(log10(greatest(n_visit + n_search + n_add + n_purchases, 1))) OVER () AS top FROM c360)
                WHERE x > 0 GROUP BY 1, 2)"""
        ),
    )
    histogram_sql = f"""SELECT CAST(least(gap // 3, 59) * 3 AS BIGINT) AS from_day, count(*) AS n_gaps,
        {r('(SELECT median(gap) FROM occ_gap)', 'p50')}, {r('(SELECT quantile_cont(gap, 0.9) FROM occ_gap)', 'p90')}
        FROM occ_gap WHERE gap <= 180 GROUP BY 1"""
    reg.add("f14_gap_histogram", store(lambda s: reports.gap_histogram(s.buy)), store_sql(histogram_sql))
    reg.add(
        "f14_gap_histogram_orders",
        lambda spark, sf: reports.gap_histogram(purchases_from_orders(spark, sf)),
        orders_sql(histogram_sql),
    )
    reg.add(
        "f15_price_bucket_rates",
        store(reports.price_bucket_rates),
        store_sql(
            f"""SELECT price_bucket, count(*) AS n_added, count(*) FILTER (buy_ts >= add_ts) AS n_converted,
                count(gone) AS n_removed, {r('count(*) FILTER (buy_ts >= add_ts) * 100.0 / count(*)', 'conversion_rate')},
                {r('count(gone) * 100.0 / count(*)', 'removal_rate')}
                FROM pair_add JOIN prod USING (sku) LEFT JOIN pair_buy USING (client_id, sku)
                LEFT JOIN (SELECT DISTINCT client_id, sku, 1 AS gone FROM removes) USING (client_id, sku) GROUP BY 1"""
        ),
    )
    z_sql = f"""SELECT category, n_customers, n_rep AS n_repurchase_customers, {r('rate', 'repurchase_rate')},
        {r('p0', 'mean_rate')}, {r('(rate - p0) / sqrt(p0 * (1 - p0) / n_customers)', 'z')}
        FROM (SELECT *, avg(rate) OVER () AS p0 FROM (
              SELECT category, count(*) AS n_customers, count(*) FILTER (k >= 2) AS n_rep, avg((k >= 2)::INT) AS rate
              FROM (SELECT client_id, category, count(*) AS k FROM cat_occ GROUP BY 1, 2) GROUP BY 1
              HAVING count(*) >= {{least}}))"""
    reg.add(
        "f17_category_repurchase_z",
        store(lambda s: reports.category_repurchase_z(s, P)),
        store_sql(z_sql.format(least=P.category_min_customers)),
    )
    from .core import orders_streams

    reg.add(
        "f17_category_repurchase_z_orders",
        lambda spark, sf: reports.category_repurchase_z(orders_streams(spark, sf), ORDERS),
        orders_sql(z_sql.format(least=ORDERS.category_min_customers)),
    )
    few = f"n_visit < {P.high_intent_visits}"
    first_groups = {
        "search_only": "n_search > 0 AND n_visit = 0",
        "visit_first_few_visits": f"n_search > 0 AND n_visit > 0 AND first_visit <= first_search AND {few}",
        "search_first_few_visits": f"first_search < first_visit AND {few}",
        "search_first": "first_search < first_visit",
    }
    first_sql = "\nUNION ALL ".join(
        f"""SELECT '{g}' AS first_action, count(*) AS n_customers, {r('avg(is_buyer::INT) * 100', 'conversion_pct')}
            FROM c360 WHERE {cond} HAVING count(*) > 0"""
        for g, cond in first_groups.items()
    )
    reg.add(
        "f19_first_action_conversion",
        store(lambda s: reports.first_action_conversion(s, P)),
        store_sql(first_sql),
    )
    band = "CASE " + " ".join(
        f"WHEN n_visit BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi in reports.VISIT_BANDS
    ) + " ELSE '100+' END"
    reg.add(
        "f20_visit_band_conversion",
        customers(reports.visit_band_conversion),
        store_sql(
            f"""SELECT {band} AS visit_band, count(*) AS n_customers, {r('avg(is_buyer::INT) * 100', 'conversion_pct')}
                FROM c360 WHERE n_search = 0 AND n_visit > 0 GROUP BY 1"""
        ),
    )
    labels = [f"label_purchase_{n}d" for n in P.label_days]
    reg.add(
        "f21_label_rates",
        store(lambda s: reports.label_rates(panel.customer_snapshot(s, P), labels)),
        store_sql(
            f"SELECT {d('s', 'snapshot_date')}, count(*) AS n_population, "
            + ", ".join(r(f"avg(label_{n})", f"label_purchase_{n}d_rate") for n in P.label_days)
            + " FROM snap GROUP BY s"
        ),
    )
    reg.add(
        "f22_removal_gap_histogram",
        store(reports.removal_gap_histogram),
        store_sql(
            """SELECT CAST(CASE WHEN x >= 1 THEN floor(log10(x) * 2) ELSE -1 END AS BIGINT) AS half_decade, count(*) AS n_pairs
               FROM (SELECT date_diff('second', add_ts, remove_ts) AS x FROM pair_removed) GROUP BY 1"""
        ),
    )
    reg.add(
        "f22_cart_hold_summary",
        store(lambda s: reports.cart_hold_summary(s, P)),
        store_sql(
            f"""SELECT count(*) AS n_clients, {r('median(x)', 'median_days_left')},
                {r(f'avg((x > {P.right_censor_days})::INT) * 100', 'pct_with_time_left')},
                {r('avg((k = 1)::INT) * 100', 'pct_single_item')}
                FROM (SELECT date_diff('day', last_add, (SELECT hi FROM edge)) AS x, n_add_sku AS k
                      FROM seg JOIN cart USING (client_id) WHERE segment = 'cart_hold' AND cart.n_add > 0)"""
        ),
    )

    # --- report facts ----------------------------------------------------------------
    def all_facts(spark, sf):
        s = from_event_table(spark, sf)
        kpis = reports.overview_kpis(s, panel.purchase_propensity(s, P), P)
        segments = reports.with_segment_notes(reports.segment_profile(s, P))
        scored = churn_scored(s).filter("split = 'test'").drop("split")
        return reports.report_facts(kpis, segments, metrics.policy_table(scored, ["label"], P.contact_rates))

    fact_rows = f"""
        SELECT 'data' AS kind, 'all' AS subject, metric, value FROM ({long_sql('life', {
            k: kpi_metrics[k] for k in ('total_customers', 'buyers', 'at_risk_customers', 'inactive_customers')})})
        UNION ALL
        SELECT 'segment', segment, m, {r('v', 'value')} FROM (
            SELECT segment, unnest(['n_customers', 'buy_rate']) AS m, unnest([n, b]) AS v
            FROM (SELECT segment, CAST(count(*) AS DOUBLE) AS n, avg(is_buyer::INT) AS b FROM seg GROUP BY 1)
            JOIN notes USING (segment) WHERE priority IN {reports.HIGH_PRIORITIES})
        UNION ALL
        SELECT 'policy', label || '/' || method, m, {r('v', 'value')} FROM (
            SELECT label, method, unnest(['recall', 'lift', 'precision']) AS m, unnest([recall, lift, prec]) AS v
            FROM churn_top WHERE split = 'test' AND rate = 10)"""
    reg.add("f23_report_facts", all_facts, store_sql(fact_rows, {**METRIC_CTES, **note_cte}))
    reg.add(
        "f24_fact_check",
        lambda spark, sf: reports.fact_check(all_facts(spark, sf)),
        store_sql(
            f"""SELECT kind, count(*) AS n_facts, count(*) FILTER (value IS NULL OR isnan(value) OR value < 0 OR
                (metric IN ('buy_rate', 'recall', 'precision') AND value > 1)) AS n_rejected
                FROM ({fact_rows}) GROUP BY 1""",
            {**METRIC_CTES, **note_cte},
        ),
    )
    first = "coalesce(" + ", ".join(f"CASE WHEN contains(text, '{x}') THEN '{x}' END" for x in TEST_PHRASES) + ")"
    reg.add(
        "f25_banned_claims_documents",
        lambda spark, sf: reports.banned_claims(
            spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"], "text", TEST_PHRASES
        ),
        f"SELECT doc_id, {first} AS banned_phrase FROM documents",
    )
    reg.add(
        "f25_banned_claims_conversations",
        lambda spark, sf: reports.banned_claims(
            spark.read.parquet(f"{sf}/conversations.parquet"),
            ["conv_id", "turn"],
            "text",
            (*reports.BANNED_CLAIMS, *TEST_PHRASES),
        ),
        f"SELECT conv_id, turn, {first} AS banned_phrase FROM conversations",
    )

