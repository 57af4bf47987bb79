"""Invariants as queries, with the same counts worked out in DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, facts, learn, marts, metrics, panel, profile, reports, staging
from ..plans.materialize import materialize
from ..sources.streams import from_event_table, products_from_parts
from .base import Registry
from .scoring import METRIC_CTES, RATES, buy_scored, churn_panel
from .sql import STORE, i, r, store_sql


def rules_sql(source: str, **rules: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) AS n_checked, count(*) FILTER ({cond}) AS n_violations FROM {source}"
        for name, cond in rules.items()
    )


def keys_sql(tables: dict[str, tuple[str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{name}' AS check_name, CAST(sum(n) AS BIGINT) AS n_checked, count(*) FILTER (n > 1) AS n_violations
            FROM (SELECT count(*) AS n FROM {source} GROUP BY {key})"""
        for name, (source, key) in tables.items()
    )


def both(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


def register(reg: Registry) -> None:
    P = STORE

    def store(fn):
        return lambda spark, sf: fn(from_event_table(spark, sf))

    client, dated = ["client_id"], ["snapshot_date", "client_id"]
    reg.add(
        "c01_fact_keys",
        store(
            lambda s: checks.key_uniqueness(
                {
                    "observation_period": (facts.observation_period(s, P), client),
                    "purchase_gap": (facts.purchase_gap(s.buy), client),
                    "cart_behavior": (facts.cart_behavior(s), client),
                    "daily_activity": (facts.daily_activity(s), ["client_id", "activity_date"]),
                    "category_behavior": (facts.category_behavior(s.buy, s.products), ["client_id", "category"]),
                }
            )
        ),
        store_sql(
            keys_sql(
                {
                    "observation_period": ("obs", "client_id"),
                    "purchase_gap": ("gaps", "client_id"),
                    "cart_behavior": ("cart", "client_id"),
                    "daily_activity": ("daily", "client_id, activity_date"),
                    "category_behavior": ("cats", "client_id, category"),
                }
            )
        ),
    )
    reg.add(
        "c01_mart_keys",
        store(
            lambda s: checks.key_uniqueness(
                {
                    "customer_360": (marts.customer_360(s, P), client),
                    "customer_weekly": (marts.customer_weekly(facts.daily_activity(s)), ["client_id", "week_start"]),
                    "customer_retention": (marts.customer_retention(s, P), ["cohort_week"]),
                    "customer_segment": (marts.customer_segment(s, P), client),
                    "customer_snapshot": (panel.customer_snapshot(s, P), dated),
                    "purchase_propensity": (panel.purchase_propensity(s, P), dated),
                }
            )
        ),
        store_sql(
            keys_sql(
                {
                    "customer_360": ("c360", "client_id"),
                    "customer_weekly": (
                        "(SELECT DISTINCT client_id, date_trunc('week', activity_date) AS w FROM daily)",
                        "client_id, w",
                    ),
                    "customer_retention": ("(SELECT DISTINCT cohort_week FROM cohort)", "cohort_week"),
                    "customer_segment": ("seg", "client_id"),
                    "customer_snapshot": ("snap", "s, client_id"),
                    "purchase_propensity": ("prop", "s, client_id"),
                }
            )
        ),
    )

    def all_staged(s):
        parts = [staging.staged(s, k, P).select(F.lit(k).alias("event_type")) for k in s.by_type()]
        return reduce(DataFrame.unionByName, parts)

    reg.add(
        "c02_row_conservation",
        store(lambda s: checks.row_conservation(s.events.select("event_type"), all_staged(s))),
        store_sql("SELECT event_type, count(*) AS n_raw, count(*) AS n_staged, false AS is_violation FROM ev GROUP BY 1"),
    )
    reg.add(
        "c03_burst_share",
        store(lambda s: checks.burst_share_range(profile.burst_rate(s, P), 0.0, 1.0)),
        store_sql(
            f"SELECT event_type, burst_pct, burst_pct NOT BETWEEN 0 AND 1 AS is_violation FROM ({_burst_sql()})"
        ),
    )
    nulls = both(
        *[
            f"""SELECT '{kind}' AS event_type, * FROM ({rules_sql(table, null_client='client_id IS NULL',
                null_time='event_ts IS NULL', null_item=f'{item} IS NULL')})"""
            for kind, table, item in (
                ("page_visit", "visits", "url"),
                ("search_query", "searches", "query"),
                ("add_to_cart", "adds", "sku"),
                ("remove_from_cart", "removes", "sku"),
                ("product_buy", "buys", "sku"),
            )
        ]
    )
    reg.add("c04_null_keys", store(checks.null_keys), store_sql(nulls))
    reg.add(
        "c05_product_range",
        lambda spark, sf: checks.product_range(products_from_parts(spark, sf)),
        store_sql(
            both(
                rules_sql("prod", price_out_of_range="price_bucket NOT BETWEEN 0 AND 99"),
                keys_sql({"sku_repeated": ("prod", "sku")}),
            )
        ),
    )

    def totals(s):
        daily = facts.daily_activity(s)
        return checks.total_agreement(s.events, daily, marts.customer_weekly(daily))

    reg.add(
        "c06_total_agreement",
        store(totals),
        store_sql(
            f"""SELECT n_raw, n_daily, {i('n_weekly')}, n_raw <> n_daily OR n_raw <> n_weekly AS is_violation FROM (
                SELECT (SELECT count(*) FROM ev) AS n_raw, (SELECT CAST(sum(n_events_total) AS BIGINT) FROM daily) AS n_daily,
                       (SELECT sum(n) FROM (SELECT sum(n_events_total) AS n FROM daily
                                            GROUP BY client_id, date_trunc('week', activity_date))) AS n_weekly)"""
        ),
    )
    reg.add(
        "c07_cart_customers",
        store(lambda s: checks.cart_customers(s, facts.cart_behavior(s))),
        store_sql(
            """SELECT *, n_cart <> n_add + n_remove - n_both AS is_violation FROM (
               SELECT (SELECT count(DISTINCT client_id) FROM adds) AS n_add,
                      (SELECT count(DISTINCT client_id) FROM removes) AS n_remove,
                      (SELECT count(*) FROM (SELECT client_id FROM adds INTERSECT SELECT client_id FROM removes)) AS n_both,
                      (SELECT count(*) FROM cart) AS n_cart)"""
        ),
    )
    reg.add(
        "c08_category_and_gap",
        store(
            lambda s: checks.category_and_gap(facts.category_behavior(s.buy, s.products), facts.purchase_history(s.buy))
        ),
        store_sql(
            both(
                rules_sql("cats", null_category="category IS NULL"),
                rules_sql("(SELECT gap FROM buys JOIN occ_gap USING (client_id, event_ts))", negative_gap="gap < 0"),
            )
        ),
    )
    reg.add(
        "c08a_pooled_gap",
        store(lambda s: checks.pooled_gap_agreement(facts.purchase_history(s.buy), facts.gap_counts(s.buy))),
        store_sql(
            f"""SELECT {r('avg(gap)', 'history_mean')}, {r('avg(gap)', 'profile_mean')}, {r('median(gap)', 'history_median')},
                {r('median(gap)', 'profile_median')}, false AS is_violation FROM occ_gap"""
        ),
    )
    reg.add(
        "c09_rate_ranges",
        store(
            lambda s: checks.rate_ranges(
                marts.customer_retention(s, P), panel.category_repurchase_by_snapshot(s, P), P
            )
        ),
        store_sql(
            both(
                rules_sql(
                    "(SELECT DISTINCT cohort_week AS w FROM cohort)",
                    **{f"retention_{n}d_out_of_range": "false" for n in P.retention_days},
                    last_cohort_not_censored=f"""w = (SELECT max(cohort_week) FROM cohort)
                        AND w + INTERVAL {max(P.retention_days)} DAY <= (SELECT hi FROM edge)""",
                ),
                rules_sql("cat_rate", category_rate_out_of_range="rate NOT BETWEEN 0 AND 1"),
            )
        ),
    )
    buyer_stages = str(checks.BUYER_STAGES)
    reg.add(
        "c10_lifecycle_rules",
        store(lambda s: checks.lifecycle_rules(marts.customer_lifecycle(s, P))),
        store_sql(
            rules_sql(
                "life",
                no_stage="stage IS NULL OR stage = 'other'",
                buyer_in_visitor_stage=f"is_buyer AND stage NOT IN {buyer_stages}",
                visitor_in_buyer_stage=f"NOT is_buyer AND stage IN {buyer_stages}",
                negative_recency="since < 0",
            )
        ),
    )
    fits = " OR ".join(
        f"(stage = '{k}' AND segment IN ({', '.join(repr(x) for x in v)}))" for k, v in checks.SEGMENTS_OF_STAGE.items()
    )
    reg.add(
        "c11_segment_rules",
        store(lambda s: checks.segment_rules(marts.customer_segment(s, P))),
        store_sql(
            rules_sql(
                "seg",
                segment_not_of_stage=f"NOT ({fits})",
                subtype_outside_cart="stage <> 'cart' AND subtype IS NOT NULL",
                cart_without_subtype="stage = 'cart' AND subtype IS NULL",
                hold_with_removal="segment = 'cart_hold' AND subtype <> 'no_removal_recorded'",
                abandon_without_removal="segment = 'cart_abandon' AND subtype = 'no_removal_recorded'",
            )
        ),
    )
    reg.add(
        "c12_label_window",
        store(lambda s: checks.label_window(panel.customer_snapshot(s, P), s, P)),
        store_sql(
            rules_sql(
                "snap", label_window_cut_off=f"s + INTERVAL {max(P.label_days)} DAY > (SELECT hi FROM edge)"
            )
        ),
    )
    columns = [f"n_purchases_{n}d" for n in sorted(P.purchase_windows)]
    steps = {f"{a}_above_{b}": f"{a} > {b}" for a, b in zip(columns, columns[1:])}
    steps[f"{columns[-1]}_above_n_purchase_occasions_so_far"] = f"{columns[-1]} > n_occ"
    reg.add(
        "c13_window_order",
        store(lambda s: checks.window_order(panel.customer_snapshot(s, P), P)),
        store_sql(rules_sql("snap", **steps)),
    )

    def label_rules(s):
        snapshot = materialize(panel.customer_snapshot(s, P))
        return checks.label_rules(snapshot, panel.churn_target(snapshot, P), P)

    label_checks = {}
    for n in P.label_days:
        label_checks |= {f"label_{n}d_not_0_or_1": f"label_{n} NOT IN (0, 1)", f"inactive_{n}d_not_opposite": "false"}
    reg.add(
        "c14_label_rules",
        store(label_rules),
        store_sql(rules_sql("snap", **label_checks, **{f"churn_{n}d_differs": "false" for n in P.label_days})),
    )
    reg.add(
        "c15_category_growth",
        store(lambda s: checks.category_growth(panel.category_repurchase_by_snapshot(s, P), P)),
        store_sql(
            rules_sql(
                "(SELECT *, lag(n) OVER (PARTITION BY category ORDER BY s) AS prev FROM cat_rate)",
                customers_fall="n < prev",
                below_min_sample=f"n < {P.category_min_customers}",
                more_repeaters_than_customers="n_rep > n",
            )
        ),
    )
    reg.add(
        "c16_history_rules",
        store(lambda s: checks.history_rules(materialize(panel.purchase_propensity(s, P)), panel.customer_snapshot(s, P))),
        store_sql(
            both(
                rules_sql(
                    "prop",
                    history_without_recency="has_history AND since IS NULL",
                    recency_without_history="NOT has_history AND since IS NOT NULL",
                    rate_without_history="NOT has_history AND avg_rate IS NOT NULL",
                ),
                rules_sql(
                    "(SELECT s, client_id, p.client_id IS NULL AS gone FROM snap LEFT JOIN prop p USING (s, client_id))",
                    churn_row_not_in_propensity="gone",
                ),
            )
        ),
    )

    def targeting(s):
        return checks.targeting_rules(metrics.policy_table(buy_scored(s), ["label", "split"], RATES), RATES)

    reg.add(
        "c17_targeting_rules",
        store(targeting),
        store_sql(
            both(
                rules_sql(
                    f"(SELECT * FROM buy_top WHERE rate IN {RATES})",
                    selected_share_off="abs(k / n - rate / 100.0) > greatest(0.01, 1.0 / n)",
                    recall_out_of_range="recall NOT BETWEEN 0 AND 1",
                    captured_above_selected="hit > k",
                ),
                rules_sql(
                    f"""(SELECT count(DISTINCT rate) AS c FROM buy_top WHERE rate IN {RATES} GROUP BY label, split, method)""",
                    rates_missing=f"c <> {len(RATES)}",
                ),
            ),
            METRIC_CTES,
        ),
    )
    spec = learn.churn_spec(P)
    reg.add(
        "c18_split_rules",
        store(lambda s: checks.split_rules(churn_panel(s), spec.features, spec.labels)),
        store_sql(
            both(
                rules_sql("churn_rows", row_without_split="split IS NULL", label_among_features="false"),
                rules_sql("(SELECT DISTINCT split FROM churn_rows)", split_overlaps_earlier="false"),
            ),
            METRIC_CTES,
        ),
    )

    def shares(s):
        segments = materialize(marts.customer_segment(s, P))
        notes = reports.with_segment_notes(segments.groupBy("segment").agg(F.count(F.lit(1)).alias("n")))
        return checks.distribution_rules(reports.distribution(segments, "lifecycle_stage"), notes)

    reg.add(
        "c19_distribution_rules",
        store(shares),
        store_sql(
            both(
                rules_sql("(SELECT 1)", shares_not_100="false"),
                rules_sql("(SELECT DISTINCT segment FROM seg)", notes_missing="segment = 'other'"),
            )
        ),
    )

    def funnel(s):
        customers = materialize(marts.customer_360(s, P))
        return checks.funnel_rules(reports.funnel_reach(customers), customers, s)

    reg.add(
        "c20_funnel_rules",
        store(funnel),
        store_sql(
            both(
                rules_sql("(SELECT unnest([1, 2, 3, 4]))", step_grows="false"),
                rules_sql("gaps", first_purchase_differs="false", first_purchase_after_last="first_ts > last_ts"),
            )
        ),
    )


def _burst_sql() -> str:
    flagged = both(
        *[
            f"""SELECT '{kind}' AS event_type, coalesce(date_diff('second', lag(event_ts) OVER (PARTITION BY {part}
                ORDER BY event_ts), event_ts) BETWEEN 0 AND {STORE.burst_seconds}, false) AS f FROM {table}"""
            for kind, table, part in (
                ("product_buy", "buys", "client_id, sku"),
                ("add_to_cart", "adds", "client_id, sku"),
                ("remove_from_cart", "removes", "client_id, sku"),
                ("page_visit", "visits", "client_id, url"),
                ("search_query", "searches", "client_id"),
            )
        ]
    )
    return f"SELECT event_type, {r('count(*) FILTER (f) * 100.0 / count(*)', 'burst_pct')} FROM ({flagged}) GROUP BY 1"
