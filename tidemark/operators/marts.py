"""Customer tables: 360 view, calendar rollups, cohorts, retention, lifecycle, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import count_where, day, days, days_between, midnight, week_start
from ..params import Params
from ..plans.ranking import exact_quantiles
from ..sources.streams import Streams
from .facts import (
    removal_gap,
    daily_activity,
    edge_occasions,
    gap_counts,
    log_end,
    log_start,
)
from .panel import category_starts

STAGES = (
    "first_purchase",
    "returned",
    "active",
    "declining",
    "at_risk",
    "inactive",
    "cart",
    "explorer",
    "other",
)
SEGMENTS = (
    "high_intent_explorer",
    "low_intent_explorer",
    "cart_hold",
    "cart_abandon",
    "first_purchase",
    "steady_repeat",
    "declining_repeat",
    "lapsed",
    "returned",
    "other",
)


def client_rollup(streams: Streams) -> DataFrame:
    """Per-client totals of all streams from the client-day rows.

    Distinct days are a count of rows, the mean gap between occasions follows from the first
    day, the last day and the occasion count, and the last gap from the last purchase day
    and the one before it.
    """
    if streams.rollup_table is not None:
        return streams.rollup_table
    occasions = F.col("n_occasions")
    bought_on = F.when(occasions > 0, F.col("d"))
    earlier = Window.partitionBy("client_id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    # days from the last occasion of a day to the one before it
    gap = F.when(occasions > 1, F.lit(0)).otherwise(F.datediff("d", F.max(bought_on).over(earlier)))
    return streams.days.withColumn("_gap", gap.cast("bigint")).groupBy("client_id").agg(
        F.min("first_ts").alias("first_event_ts"),
        F.max("last_ts").alias("last_event_ts"),
        F.count("d").alias("n_active_days"),
        F.sum("n_page_visit").alias("n_page_visit"),
        F.sum("n_search_query").alias("n_search_query"),
        F.sum("n_add_to_cart").alias("n_add_to_cart"),
        F.sum("n_remove_from_cart").alias("n_remove_from_cart"),
        F.sum("n_product_buy").alias("n_purchases"),
        count_where(F.col("n_occasions") > 0).alias("n_purchase_days"),
        F.sum("n_occasions").alias("n_occasions"),
        F.min("first_buy_ts").alias("first_purchase_ts"),
        F.max("last_buy_ts").alias("last_purchase_ts"),
        F.min("first_visit_ts").alias("first_visit_ts"),
        F.min("first_search_ts").alias("first_search_ts"),
        F.max_by("_gap", bought_on).alias("gap_before_last_purchase"),
    )


def _customer_360(streams: Streams, p: Params) -> DataFrame:
    r = client_rollup(streams)
    first = F.col("first_event_ts")
    span = days_between("first_purchase_ts", "last_purchase_ts")
    return r.select(
        "client_id",
        "first_event_ts",
        "last_event_ts",
        days_between("first_event_ts", "last_event_ts").alias("observation_days"),
        "n_active_days",
        (first < log_start(streams) + days(p.left_censor_days)).alias("is_left_censor_candidate"),
        (first >= log_end(streams) - days(p.right_censor_days)).alias("is_right_censor_candidate"),
        "n_page_visit",
        "n_search_query",
        "n_add_to_cart",
        "n_remove_from_cart",
        "n_purchases",
        "n_purchase_days",
        "first_purchase_ts",
        "last_purchase_ts",
        F.when(F.col("n_occasions") > 1, span / (F.col("n_occasions") - 1)).alias("avg_purchase_gap_days"),
        (F.col("n_purchases") > 0).alias("is_buyer"),
        (F.col("n_add_to_cart") + F.col("n_remove_from_cart") > 0).alias("has_cart_activity"),
        (F.col("n_purchase_days") >= 2).alias("is_repeat_capable"),
        "first_visit_ts",
        "first_search_ts",
        "gap_before_last_purchase",
    )


def customer_360(streams: Streams, p: Params) -> DataFrame:
    """One row per client: counts, purchase summary and flags; removals alone count as cart use."""
    return _customer_360(streams, p).drop("first_visit_ts", "first_search_ts", "gap_before_last_purchase")


def customer_daily(streams: Streams) -> DataFrame:
    return daily_activity(streams)


def customer_weekly(daily: DataFrame) -> DataFrame:
    sums = [
        "n_page_visit",
        "n_search_query",
        "n_add_to_cart",
        "n_remove_from_cart",
        "n_product_buy",
        "n_events_total",
    ]
    return daily.groupBy("client_id", week_start("activity_date").alias("week_start")).agg(
        *[F.sum(c).alias(c) for c in sums], F.count("activity_date").alias("n_active_days_in_week")
    )


def customer_cohort(gaps: DataFrame) -> DataFrame:
    """First-purchase week of each buyer, from the purchase-gap table."""
    return gaps.select(
        "client_id",
        "first_purchase_ts",
        week_start("first_purchase_ts").alias("cohort_week"),
        "n_purchases",
        "n_purchase_days",
        "avg_purchase_gap_days",
    )


def customer_retention(streams: Streams, p: Params) -> DataFrame:
    """Repurchase rates per weekly cohort.

    Only the second occasion decides whether a client came back within N days. The
    censoring flags are measured from the cohort's Monday.
    """
    edges = edge_occasions(streams.buy)
    diversity = category_starts(streams).groupBy("client_id").agg(F.count("category").alias("n_categories"))
    diversity = diversity.filter(F.col("n_categories") > 0)
    clients = edges.join(_purchase_days(streams), "client_id").join(diversity, "client_id", "left")

    def back_within(n):
        return F.coalesce((F.col("ts_2") <= F.col("ts_1") + days(n)).cast("double"), F.lit(0.0))

    cohorts = clients.groupBy(week_start("ts_1").alias("cohort_week")).agg(
        F.count(F.lit(1)).alias("n_customers_in_cohort"),
        *[F.avg(back_within(n)).alias(f"repurchase_{n}d_rate") for n in p.retention_days],
        F.avg("n_purchase_days").alias("avg_purchase_days"),
        F.avg("n_categories").alias("avg_category_diversity"),
    )
    end = log_end(streams)
    return cohorts.select(
        "*",
        *[
            (midnight("cohort_week") + days(n) > end).alias(f"is_{n}d_window_censored")
            for n in p.retention_days
        ],
    )


def _purchase_days(streams: Streams) -> DataFrame:
    if streams.rollup_table is not None:
        return streams.rollup_table.filter(F.col("n_purchase_days") > 0).select("client_id", "n_purchase_days")
    return purchase_days(streams.buy)


def purchase_days(buy: DataFrame) -> DataFrame:
    per_day = buy.filter(F.col("event_ts").isNotNull()).select("client_id", day("event_ts").alias("d")).distinct()
    return per_day.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_purchase_days"))


def stage_of(p: Params) -> Column:
    """Lifecycle stage from recency, purchase days and the gap before the last purchase."""
    buyer, since, bought = F.col("is_buyer"), F.col("days_since_last_purchase"), F.col("n_purchase_days")
    recent = buyer & (since <= p.recent_days)
    return (
        F.when(recent & (bought == 1), "first_purchase")
        .when(recent & (bought >= 2) & (F.col("gap_before_last_purchase") > p.return_gap_days), "returned")
        .when(recent & (bought >= 2), "active")
        .when(buyer & since.between(p.recent_days + 1, p.declining_days), "declining")
        .when(buyer & since.between(p.declining_days + 1, p.at_risk_days), "at_risk")
        .when(buyer & (since > p.at_risk_days), "inactive")
        .when(~buyer & F.col("has_cart_activity"), "cart")
        .when(~buyer & ((F.col("n_page_visit") > 0) | (F.col("n_search_query") > 0)), "explorer")
        .otherwise("other")
    )


def staged_customers(streams: Streams, p: Params) -> DataFrame:
    """The 360 view with what the lifecycle stage and the segment are made from."""
    since = days_between("last_purchase_ts", log_end(streams))
    return (
        _customer_360(streams, p)
        .withColumn("days_since_last_purchase", since)
        .withColumn("lifecycle_stage", stage_of(p))
    )


def customer_lifecycle(streams: Streams, p: Params) -> DataFrame:
    return staged_customers(streams, p).select(
        "client_id",
        "is_buyer",
        "n_purchase_days",
        "days_since_last_purchase",
        "gap_before_last_purchase",
        "lifecycle_stage",
    )


def lifecycle_from_purchases(buy: DataFrame, p: Params) -> DataFrame:
    """Buyer stages when the purchases are the only stream; the last purchase ends the log."""
    edges = edge_occasions(buy, last=True)
    none = F.lit(0).cast("bigint")
    return (
        edges.join(purchase_days(buy), "client_id")
        .select(
            "client_id",
            F.lit(True).alias("is_buyer"),
            "n_purchase_days",
            days_between("ts_1", buy.agg(F.max("event_ts")).scalar()).alias("days_since_last_purchase"),
            days_between("ts_2", "ts_1").alias("gap_before_last_purchase"),
            F.lit(False).alias("has_cart_activity"),
            none.alias("n_page_visit"),
            none.alias("n_search_query"),
        )
        .withColumn("lifecycle_stage", stage_of(p))
        .drop("has_cart_activity", "n_page_visit", "n_search_query")
    )


def lifecycle_thresholds(buy: DataFrame) -> DataFrame:
    """Day limits the lifecycle stages are derived from: 1.5 and 3 medians and p90 of the gaps.

    Gaps are whole days, so the counts per gap are few.
    """
    return gap_counts(buy).select(F.percentile("gap", F.array(F.lit(0.5), F.lit(0.9)), F.col("n")).alias("q")).select(
        F.col("q")[0].alias("median_gap_days"),
        (F.col("q")[0] * 1.5).alias("recent_days"),
        (F.col("q")[0] * 3.0).alias("declining_days"),
        F.col("q")[1].alias("at_risk_days"),
    )


def segmented_customers(streams: Streams, p: Params, carts: DataFrame | None = None) -> DataFrame:
    """``staged_customers`` with nine segments on top of the stages, and how carts were given up.

    ``carts`` may be the written cart-behaviour table.
    """
    carts = removal_gap(streams) if carts is None else carts
    carts = carts.select("client_id", "median_seconds_add_to_remove")
    rows = staged_customers(streams, p).join(carts, "client_id", "left")
    stage, gap = F.col("lifecycle_stage"), F.col("median_seconds_add_to_remove")
    subtype = (
        F.when(stage != "cart", None)
        .when(gap.isNull(), "no_removal_recorded")
        .when(gap <= p.fast_removal_seconds, "fast_removal")
        .otherwise("slow_removal")
    )
    eager = (F.col("n_page_visit") >= p.high_intent_visits) | (F.col("first_search_ts") < F.col("first_visit_ts"))
    segment = (
        F.when((stage == "explorer") & eager, "high_intent_explorer")
        .when(stage == "explorer", "low_intent_explorer")
        .when((stage == "cart") & gap.isNull(), "cart_hold")
        .when(stage == "cart", "cart_abandon")
        .when(stage == "first_purchase", "first_purchase")
        .when(stage == "active", "steady_repeat")
        .when(stage == "declining", "declining_repeat")
        .when(stage.isin("at_risk", "inactive"), "lapsed")
        .when(stage == "returned", "returned")
        .otherwise("other")
    )
    return rows.withColumns({"segment": segment, "cart_removal_subtype": subtype})


def customer_segment(streams: Streams, p: Params, carts: DataFrame | None = None) -> DataFrame:
    """Stage, segment and cart subtype per client."""
    rows = segmented_customers(streams, p, carts)
    return rows.select("client_id", "lifecycle_stage", "segment", "cart_removal_subtype")


def candidate_clients(streams: Streams, p: Params) -> DataFrame:
    """Clients who can enter the propensity panel at some date, with their first search and visit."""
    first_search, first_visit = F.col("first_search_ts"), F.col("first_visit_ts")
    enters = (
        (F.col("n_page_visit") >= p.high_intent_visits)
        | F.coalesce(first_search < first_visit, F.lit(False))
        | (F.col("n_add_to_cart") + F.col("n_remove_from_cart") > 0)
        | (F.col("n_purchases") > 0)
    )
    return client_rollup(streams).filter(enters).select("client_id", "first_search_ts", "first_visit_ts")


def visit_cut(streams: Streams, p: Params, prob: float = 0.9) -> DataFrame:
    """Visit count that cuts off the most active explorers."""
    explorers = staged_customers(streams, p).filter(F.col("lifecycle_stage") == "explorer")
    return exact_quantiles(explorers, "n_page_visit", [prob]).select(
        F.col("prob"), F.col("quantile").alias("visit_cut")
    )
