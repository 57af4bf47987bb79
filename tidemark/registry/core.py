"""Staging, per-customer facts, panels and marts."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, marts, panel, staging
from ..plans.grid import snapshot_dates
from ..plans.materialize import new_folder
from ..sources.streams import (
    ITEM_KEY,
    from_event_table,
    products_from_parts,
    purchases_from_orders,
    read_streams,
    typed_events,
    write_raw,
)
from .base import Registry
from .sql import ORDERS, STORE, d, i, orders_sql, r, store_sql, t

KINDS = ("page_visit", "search_query", "add_to_cart", "remove_from_cart")


def register(reg: Registry) -> None:
    P, O = STORE, ORDERS

    def store(fn):
        return lambda spark, sf: fn(from_event_table(spark, sf))

    def orders(fn):
        return lambda spark, sf: fn(purchases_from_orders(spark, sf))

    # --- sources and staging -------------------------------------------------------
    def scanned(spark, sf):
        """The test tables written as source files and read by the source scan."""
        folder = new_folder(spark, "raw")
        write_raw(spark, sf, folder)
        return read_streams(spark, folder)

    def all_streams(spark, sf):
        parts = [
            df.select(F.lit(name).alias("event_type"), "client_id", "event_ts", F.col(ITEM_KEY[name]).cast("string").alias("item"))
            for name, df in scanned(spark, sf).by_type().items()
        ]
        return reduce(DataFrame.unionByName, parts)

    keyed = {"product_buy": ("buys", "sku"), "add_to_cart": ("adds", "sku"), "remove_from_cart": ("removes", "sku"),
             "page_visit": ("visits", "url"), "search_query": ("searches", "query")}
    reg.add(
        "s01_event_scan",
        all_streams,
        store_sql(
            "\nUNION ALL ".join(
                f"SELECT '{name}' AS event_type, client_id, {t('event_ts')}, CAST({key} AS VARCHAR) AS item FROM {table}"
                for name, (table, key) in keyed.items()
            )
        ),
    )
    reg.add("s02_product_scan", lambda spark, sf: scanned(spark, sf).products, store_sql("SELECT * FROM prod"))

    def typed(spark, sf):
        text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("ts").cast("string"))
        raw = spark.read.parquet(f"{sf}/events.parquet").select(
            F.col("user_id").alias("client_id"), text.alias("timestamp"), "event_id"
        )
        return typed_events(raw, "event_id")

    reg.add(
        "t01_typed_event",
        typed,
        f"""SELECT client_id, event_id, {t('event_ts')} FROM (
                SELECT user_id AS client_id, event_id,
                       TRY_CAST(CASE WHEN event_type = 'error' THEN props ELSE CAST(ts AS VARCHAR) END
                                AS TIMESTAMP) AS event_ts FROM events)""",
    )
    burst_names = {
        "product_buy": ("t02_burst_buy", "buys", "sku"),
        "add_to_cart": ("t02a_burst_add", "adds", "sku"),
        "remove_from_cart": ("t02a_burst_remove", "removes", "sku"),
        "page_visit": ("t02b_burst_visit", "visits", "url"),
        "search_query": ("t02c_burst_search", "searches", "query"),
    }
    for kind, (name, table, key) in burst_names.items():
        part = "client_id" if kind == "search_query" else f"client_id, {key}"
        reg.add(
            name,
            store(lambda s, kind=kind: staging.staged(s, kind, P)),
            store_sql(
                f"""SELECT client_id, {t('event_ts')}, {key},
                    coalesce(date_diff('second', lag(event_ts) OVER (PARTITION BY {part} ORDER BY event_ts), event_ts)
                             BETWEEN 0 AND {P.burst_seconds}, false) AS is_burst_repeat FROM {table}"""
            ),
        )
    reg.add(
        "t03_unified_events",
        store(staging.unified_events),
        store_sql(f"SELECT client_id, {t('event_ts')}, event_type FROM ev"),
    )

    # --- per-customer facts --------------------------------------------------------
    reg.add(
        "i01_observation_period",
        store(lambda s: facts.observation_period(s, P)),
        store_sql(
            f"""SELECT client_id, {t('first_ts', 'first_event_ts')}, {t('last_ts', 'last_event_ts')},
                obs_days AS observation_days, active_days AS n_active_days, left_c AS is_left_censor_candidate,
                right_c AS is_right_censor_candidate FROM obs"""
        ),
    )
    gap_sql = f"""SELECT client_id, n_purchases, n_days AS n_purchase_days, {t('first_ts', 'first_purchase_ts')},
        {t('last_ts', 'last_purchase_ts')}, {r('avg_gap', 'avg_purchase_gap_days')},
        {r('sd_gap', 'stddev_purchase_gap_days')}, min_gap AS min_purchase_gap_days,
        max_gap AS max_purchase_gap_days FROM gaps"""
    reg.add("i02_purchase_gap", store(lambda s: facts.purchase_gap(s.buy)), store_sql(gap_sql))
    reg.add("i02_purchase_gap_orders", orders(facts.purchase_gap), orders_sql(gap_sql))
    history_sql = f"""SELECT b.client_id, {t('b.event_ts')}, b.sku,
        row_number() OVER (PARTITION BY b.client_id ORDER BY b.event_ts, b.sku) AS raw_row_seq,
        seq AS purchase_occasion_seq, gap AS days_since_prev_purchase_occasion,
        seq = 1 AS is_first_observed_purchase
        FROM buys b JOIN occ_gap USING (client_id, event_ts)"""
    reg.add("i03_purchase_history", store(lambda s: facts.purchase_history(s.buy)), store_sql(history_sql))
    reg.add("i03_purchase_history_orders", orders(facts.purchase_history), orders_sql(history_sql))
    reg.add(
        "i04_cart_behavior",
        store(facts.cart_behavior),
        store_sql(
            f"""SELECT client_id, n_add, n_add_sku AS n_add_distinct_sku, {t('first_add', 'first_add_ts')},
                {t('last_add', 'last_add_ts')}, n_remove, n_remove_sku AS n_remove_distinct_sku,
                {t('first_remove', 'first_remove_ts')}, {t('last_remove', 'last_remove_ts')},
                n_pairs AS n_add_to_buy_pairs, {r('hours', 'avg_hours_add_to_buy')},
                {r('removal_secs', 'median_seconds_add_to_remove')} FROM cart"""
        ),
    )
    reg.add(
        "i04a_add_remove_summary",
        store(
            lambda s: facts.cart_behavior(s).select(
                "client_id", "n_add", "n_add_distinct_sku", "n_remove", "n_remove_distinct_sku"
            )
        ),
        store_sql(
            """SELECT client_id, count(*) FILTER (event_type = 'add_to_cart') AS n_add,
               count(DISTINCT sku) FILTER (event_type = 'add_to_cart') AS n_add_distinct_sku,
               count(*) FILTER (event_type = 'remove_from_cart') AS n_remove,
               count(DISTINCT sku) FILTER (event_type = 'remove_from_cart') AS n_remove_distinct_sku
               FROM ev WHERE event_type IN ('add_to_cart', 'remove_from_cart') GROUP BY 1"""
        ),
    )
    reg.add(
        "i04b_first_add_buy",
        store(
            lambda s: facts.cart_pairs(s)
            .filter(F.col("first_add_ts").isNotNull() | F.col("first_buy_ts").isNotNull())
            .select("client_id", "sku", "first_add_ts", "first_buy_ts")
        ),
        store_sql(
            f"""SELECT client_id, sku, {t('add_ts', 'first_add_ts')}, {t('buy_ts', 'first_buy_ts')}
                FROM pair_add FULL JOIN pair_buy USING (client_id, sku)"""
        ),
    )
    reg.add(
        "i04c_add_to_buy_hours",
        store(facts.add_to_buy_hours),
        store_sql(
            f"""SELECT client_id, count(*) AS n_add_to_buy_pairs,
                {r("avg(date_diff('second', add_ts, buy_ts) / 3600.0)", 'avg_hours_add_to_buy')}
                FROM pair_add JOIN pair_buy USING (client_id, sku) WHERE buy_ts >= add_ts GROUP BY 1"""
        ),
    )
    reg.add(
        "i04e_cart_clients",
        store(facts.cart_clients),
        store_sql("SELECT client_id FROM adds UNION SELECT client_id FROM removes"),
    )
    reg.add(
        "i04d_first_remove_after_add",
        store(
            lambda s: facts.cart_pairs(s)
            .filter(F.col("remove_after_add_ts").isNotNull())
            .select("client_id", "sku", "first_add_ts", "remove_after_add_ts")
        ),
        store_sql(
            f"SELECT client_id, sku, {t('add_ts', 'first_add_ts')}, {t('remove_ts', 'remove_after_add_ts')} FROM pair_removed"
        ),
    )
    daily_sql = f"""SELECT client_id, {d('activity_date')}, n_page_visit, n_search_query, n_add_to_cart,
        n_remove_from_cart, n_product_buy, n_events_total, n_event_types_active FROM daily"""
    reg.add("i05_daily_activity", store(lambda s: facts.daily_activity(s)), store_sql(daily_sql))
    cat_sql = f"""SELECT client_id, category, n_purchases, n_sku AS n_distinct_sku,
        {t('first_ts', 'first_purchase_ts')}, {t('last_ts', 'last_purchase_ts')} FROM cats"""
    reg.add(
        "i06_category_behavior", store(lambda s: facts.category_behavior(s.buy, s.products)), store_sql(cat_sql)
    )
    reg.add(
        "i06_category_behavior_orders",
        lambda spark, sf: facts.category_behavior(purchases_from_orders(spark, sf), products_from_parts(spark, sf)),
        orders_sql(cat_sql),
    )
    reg.add(
        "i07_snapshot_grid",
        store(lambda s: snapshot_dates(s.bounds, P)),
        store_sql(f"SELECT {d('s', 'snapshot_date')} FROM grid"),
    )
    reg.add(
        "i08_category_repurchase",
        store(lambda s: panel.category_repurchase_by_snapshot(s, P)),
        store_sql(
            f"""SELECT {d('s', 'snapshot_date')}, category, n AS n_customers, {i('n_rep', 'n_repurchase_customers')},
                {r('rate', 'repurchase_rate')} FROM cat_rate"""
        ),
    )
    reg.add(
        "i09_category_repurchase_avg",
        store(lambda s: panel.category_repurchase_avg_by_snapshot(s, P)),
        store_sql(
            f"SELECT {d('s', 'snapshot_date')}, client_id, {r('avg_rate', 'avg_category_repurchase_rate')} FROM cat_avg"
        ),
    )

    # --- marts ---------------------------------------------------------------------
    reg.add(
        "m01_customer_360",
        store(lambda s: marts.customer_360(s, P)),
        store_sql(
            f"""SELECT client_id, {t('first_ts', 'first_event_ts')}, {t('last_ts', 'last_event_ts')},
                obs_days AS observation_days, active_days AS n_active_days, left_c AS is_left_censor_candidate,
                right_c AS is_right_censor_candidate, n_visit AS n_page_visit, n_search AS n_search_query,
                n_add AS n_add_to_cart, n_remove AS n_remove_from_cart, n_purchases, n_purchase_days,
                {t('first_buy', 'first_purchase_ts')}, {t('last_buy', 'last_purchase_ts')},
                {r('avg_gap', 'avg_purchase_gap_days')}, is_buyer, has_cart AS has_cart_activity,
                is_repeat AS is_repeat_capable FROM c360"""
        ),
    )
    reg.add("m02_customer_daily", store(marts.customer_daily), store_sql(daily_sql))
    reg.add(
        "m03_customer_weekly",
        store(lambda s: marts.customer_weekly(marts.customer_daily(s))),
        store_sql(
            f"""SELECT client_id, {d("date_trunc('week', activity_date)", 'week_start')},
                {i('sum(n_page_visit)', 'n_page_visit')}, {i('sum(n_search_query)', 'n_search_query')},
                {i('sum(n_add_to_cart)', 'n_add_to_cart')}, {i('sum(n_remove_from_cart)', 'n_remove_from_cart')},
                {i('sum(n_product_buy)', 'n_product_buy')}, {i('sum(n_events_total)', 'n_events_total')},
                count(DISTINCT activity_date) AS n_active_days_in_week
                FROM daily GROUP BY client_id, date_trunc('week', activity_date)"""
        ),
    )
    cohort_sql = f"""SELECT client_id, {t('first_ts', 'first_purchase_ts')}, {d('cohort_week')}, n_purchases,
        n_days AS n_purchase_days, {r('avg_gap', 'avg_purchase_gap_days')} FROM cohort"""
    reg.add("m04_customer_cohort", store(lambda s: marts.customer_cohort(facts.purchase_gap(s.buy))), store_sql(cohort_sql))
    reg.add("m04_customer_cohort_orders", orders(lambda b: marts.customer_cohort(facts.purchase_gap(b))), orders_sql(cohort_sql))

    def retention_sql(p):
        rates = ", ".join(r(f"avg(back_{n})", f"repurchase_{n}d_rate") for n in p.retention_days)
        flags = ", ".join(
            f"cohort_week + INTERVAL {n} DAY > (SELECT hi FROM edge) AS is_{n}d_window_censored" for n in p.retention_days
        )
        backs = ", ".join(
            f"""max(CASE WHEN o.event_ts > first_ts AND o.event_ts <= first_ts + INTERVAL {n} DAY THEN 1 ELSE 0 END)
                AS back_{n}"""
            for n in p.retention_days
        )
        return f"""SELECT {d('cohort_week')}, count(*) AS n_customers_in_cohort, {rates},
            {r('avg(n_days)', 'avg_purchase_days')}, {r('avg(n_cat)', 'avg_category_diversity')}, {flags}
            FROM (SELECT c.client_id, cohort_week, n_days, {backs} FROM cohort c LEFT JOIN occ o USING (client_id)
                  GROUP BY 1, 2, 3)
            LEFT JOIN (SELECT client_id, count(DISTINCT category) AS n_cat FROM cats GROUP BY 1) USING (client_id)
            GROUP BY cohort_week"""

    reg.add("m05_customer_retention", store(lambda s: marts.customer_retention(s, P)), store_sql(retention_sql(P)))
    reg.add(
        "m05_customer_retention_orders",
        lambda spark, sf: marts.customer_retention(orders_streams(spark, sf), O),
        orders_sql(retention_sql(O)),
    )
    reg.add(
        "m06_customer_lifecycle",
        store(lambda s: marts.customer_lifecycle(s, P)),
        store_sql(
            """SELECT client_id, is_buyer, n_purchase_days, since AS days_since_last_purchase,
               last_gap AS gap_before_last_purchase, stage AS lifecycle_stage FROM life"""
        ),
    )
    reg.add(
        "m06_customer_lifecycle_orders",
        orders(lambda b: marts.lifecycle_from_purchases(b, O)),
        orders_sql(
            f"""SELECT client_id, true AS is_buyer, n_days AS n_purchase_days, since AS days_since_last_purchase,
                last_gap AS gap_before_last_purchase,
                CASE WHEN since <= {O.recent_days} AND n_days = 1 THEN 'first_purchase'
                     WHEN since <= {O.recent_days} AND last_gap > {O.return_gap_days} THEN 'returned'
                     WHEN since <= {O.recent_days} THEN 'active' WHEN since <= {O.declining_days} THEN 'declining'
                     WHEN since <= {O.at_risk_days} THEN 'at_risk' ELSE 'inactive' END AS lifecycle_stage
                FROM (SELECT client_id, n_days, date_diff('day', last_ts, (SELECT hi FROM edge)) AS since,
                             nullif(last_gap, -1) AS last_gap FROM gaps JOIN last_gap USING (client_id))"""
        ),
    )
    limits_sql = f"""SELECT {r('median(gap)', 'median_gap_days')}, {r('median(gap) * 1.5', 'recent_days')},
        {r('median(gap) * 3', 'declining_days')}, {r('quantile_cont(gap, 0.9)', 'at_risk_days')} FROM occ_gap"""
    reg.add("m06a_lifecycle_thresholds", store(lambda s: marts.lifecycle_thresholds(s.buy)), store_sql(limits_sql))
    reg.add("m06a_lifecycle_thresholds_orders", orders(marts.lifecycle_thresholds), orders_sql(limits_sql))
    reg.add(
        "m07_customer_segment",
        store(lambda s: marts.customer_segment(s, P)),
        store_sql("SELECT client_id, stage AS lifecycle_stage, segment, subtype AS cart_removal_subtype FROM seg"),
    )
    reg.add(
        "m07a_visit_cut",
        store(lambda s: marts.visit_cut(s, P)),
        store_sql(
            f"SELECT 0.9::DOUBLE AS prob, {r('quantile_cont(n_visit, 0.9)', 'visit_cut')} FROM life WHERE stage = 'explorer'"
        ),
    )
    a = P.activity_days
    counts = ", ".join(f"n_{k}_{a}d" for k in KINDS)
    windows = ", ".join(f"n_purchases_{n}d" for n in P.purchase_windows)
    snapshot_head = f"""{d('s', 'snapshot_date')}, client_id, {t('last_ts', 'last_purchase_ts')},
        since AS days_since_last_purchase, n_occ AS n_purchase_occasions_so_far, n_days AS n_purchase_days_so_far,
        {r('avg_gap', 'avg_purchase_gap_days_so_far')}, {windows}, n_categories AS n_categories_so_far,
        {r('avg_rate', 'avg_category_repurchase_rate')}, {counts}"""
    labels = ", ".join(
        f"label_{n} AS label_purchase_{n}d, label_{n} = 0 AS label_inactive_{n}d" for n in P.label_days
    )
    churn = ", ".join(f"label_{n} = 0 AS churn_{n}d" for n in P.label_days)
    will = ", ".join(f"label_{n} AS will_purchase_{n}d" for n in P.label_days)
    reg.add(
        "m08_customer_snapshot",
        store(lambda s: panel.customer_snapshot(s, P)),
        store_sql(f"SELECT {snapshot_head}, {labels} FROM snap"),
    )
    # dates in uneven distances, some next to each other and some outside the log
    listed = replace(P, snapshot_days=tuple(date(2024, 1, k) for k in (3, 8, 9, 13, 14, 20, 22, 28)))
    days_sql = ", ".join(f"DATE '{x}'" for x in listed.snapshot_days)
    listed_sql = {
        "grid": f"""
            SELECT s FROM (SELECT unnest([{days_sql}]) AS s), edge
            WHERE s BETWEEN CAST(lo AS DATE) + INTERVAL {P.grid_lead_days} DAY AND CAST(hi AS DATE) - INTERVAL {P.grid_trail_days} DAY"""
    }
    reg.add(
        "m08_customer_snapshot_listed",
        store(lambda s: panel.customer_snapshot(s, listed)),
        store_sql(f"SELECT {snapshot_head}, {labels} FROM snap", listed_sql),
    )
    reg.add(
        "m10_purchase_propensity_listed",
        store(lambda s: panel.purchase_propensity(s, listed)),
        store_sql(
            f"""SELECT {d('s', 'snapshot_date')}, client_id, has_history AS has_purchase_history,
                {t('last_ts', 'last_purchase_ts')}, since AS days_since_last_purchase,
                n_occ AS n_purchase_occasions_so_far, {counts}, {r('avg_rate', 'avg_category_repurchase_rate')}, {will}
                FROM prop""",
            listed_sql,
        ),
    )
    reg.add(
        "m09_churn_target",
        store(lambda s: panel.churn_target(panel.customer_snapshot(s, P), P)),
        store_sql(f"SELECT {snapshot_head}, {churn} FROM snap"),
    )
    reg.add(
        "m10_purchase_propensity",
        store(lambda s: panel.purchase_propensity(s, P)),
        store_sql(
            f"""SELECT {d('s', 'snapshot_date')}, client_id, has_history AS has_purchase_history,
                {t('last_ts', 'last_purchase_ts')}, since AS days_since_last_purchase,
                n_occ AS n_purchase_occasions_so_far, {counts}, {r('avg_rate', 'avg_category_repurchase_rate')}, {will}
                FROM prop"""
        ),
    )

    # --- parts of the panels -----------------------------------------------------------
    def part_of(table, *columns):
        return store(lambda s: table(s, P).select("snapshot_date", "client_id", *columns))

    key_sql = f"{d('s', 'snapshot_date')}, client_id"
    reg.add(
        "m08a_spine",
        part_of(panel.customer_snapshot),
        store_sql(f"SELECT DISTINCT {key_sql} FROM occ JOIN grid ON event_ts < s"),
    )
    reg.add(
        "m08c_recency_frequency",
        part_of(
            panel.customer_snapshot,
            "last_purchase_ts",
            "n_purchase_occasions_so_far",
            "n_purchase_days_so_far",
            "avg_purchase_gap_days_so_far",
            *[f"n_purchases_{n}d" for n in P.purchase_windows],
        ),
        store_sql(
            f"""SELECT {key_sql}, {t('last_ts', 'last_purchase_ts')}, n_occ AS n_purchase_occasions_so_far,
                n_days AS n_purchase_days_so_far, {r('avg_gap', 'avg_purchase_gap_days_so_far')}, {windows} FROM past"""
        ),
    )
    reg.add(
        "m08d_categories_so_far",
        part_of(panel.customer_snapshot, "n_categories_so_far"),
        store_sql(f"SELECT {key_sql}, coalesce(n_categories, 0) AS n_categories_so_far FROM past LEFT JOIN n_cat USING (s, client_id)"),
    )
    reg.add(
        "m08e_recent_activity",
        part_of(panel.customer_snapshot, *[f"n_{k}_{a}d" for k in KINDS]),
        store_sql(f"SELECT {key_sql}, {counts} FROM recent SEMI JOIN past USING (s, client_id)"),
    )
    reg.add(
        "m08f_labels",
        part_of(panel.customer_snapshot, *[f"label_purchase_{n}d" for n in P.label_days]),
        store_sql(
            f"SELECT {key_sql}, "
            + ", ".join(f"label_{n} AS label_purchase_{n}d" for n in P.label_days)
            + " FROM ahead SEMI JOIN past USING (s, client_id)"
        ),
    )
    reg.add(
        "m10a_candidates",
        store(lambda s: marts.candidate_clients(s, P)),
        store_sql(
            f"""SELECT client_id, {t('first_search', 'first_search_ts')}, {t('first_visit', 'first_visit_ts')} FROM c360
                WHERE n_visit >= {P.high_intent_visits} OR first_search < first_visit OR has_cart OR is_buyer"""
        ),
    )
    reg.add(
        "m10b_activity_before",
        store(
            lambda s: panel.population(s, P).select(
                "snapshot_date", "client_id", "cum_visits", "cum_adds", *[f"n_{k}_{a}d" for k in KINDS]
            )
        ),
        store_sql(f"SELECT {key_sql}, cum_visits, cum_adds, {counts} FROM prop"),
    )
    reg.add(
        "m10c_population",
        part_of(panel.population),
        store_sql(
            f"""SELECT {key_sql} FROM recent
                WHERE cum_visits >= {P.high_intent_visits} OR fs < fv OR cum_adds > 0
                UNION SELECT {key_sql} FROM past"""
        ),
    )

    # --- long history on orders ------------------------------------------------------
    reg.add(
        "i08_category_repurchase_orders",
        lambda spark, sf: panel.category_repurchase_by_snapshot(orders_streams(spark, sf), O),
        orders_sql(
            f"""SELECT {d('s', 'snapshot_date')}, category, n AS n_customers, {i('n_rep', 'n_repurchase_customers')},
                {r('rate', 'repurchase_rate')} FROM cat_rate"""
        ),
    )
    reg.add(
        "i09_category_repurchase_avg_orders",
        lambda spark, sf: panel.category_repurchase_avg_by_snapshot(orders_streams(spark, sf), O),
        orders_sql(
            f"SELECT {d('s', 'snapshot_date')}, client_id, {r('avg_rate', 'avg_category_repurchase_rate')} FROM cat_avg"
        ),
    )


def orders_streams(spark, sf):
    """Streams with order lines as the only events."""
    from ..sources.streams import Streams

    buy = purchases_from_orders(spark, sf)
    tagged = buy.select("client_id", "event_ts", F.lit("product_buy").alias("event_type"), "sku")
    none = buy.filter(F.lit(False))
    return Streams(
        buy=buy,
        add=none,
        remove=none,
        visit=none.withColumnRenamed("sku", "url"),
        search=none.withColumnRenamed("sku", "query"),
        products=products_from_parts(spark, sf),
        tagged=tagged,
    )
