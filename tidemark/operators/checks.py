"""Invariants of the tables. Each check returns counts, with violations in their own column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import count_where, day, days, midnight
from ..params import Params
from ..sources.streams import Streams
from .facts import log_end


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """Rows checked and rows breaking each rule, as ``(check_name, n_checked, n_violations)``."""
    one = df.agg(
        F.count(F.lit(1)).alias("n_checked"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]
    )
    return one.unpivot(["n_checked"], list(rules), "check_name", "n_violations").select(
        "check_name", "n_checked", "n_violations"
    )


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key_uniqueness(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Duplicated keys per table."""
    parts = []
    for name, (df, key) in tables.items():
        per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_checked"),
                count_where(F.col("n") > 1).alias("n_violations"),
            ).select(F.lit(name).alias("check_name"), "n_checked", "n_violations")
        )
    return together(*parts)


def row_conservation(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows per event type before and after staging."""
    a = raw.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_raw"))
    b = staged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_staged"))
    return a.join(b, "event_type", "full").select(
        "event_type",
        F.coalesce("n_raw", F.lit(0)).alias("n_raw"),
        F.coalesce("n_staged", F.lit(0)).alias("n_staged"),
        (F.coalesce("n_raw", F.lit(0)) != F.coalesce("n_staged", F.lit(0))).alias("is_violation"),
    )


def burst_share_range(rates: DataFrame, lo: float, hi: float) -> DataFrame:
    """Burst share per type against an expected range in %."""
    return rates.select("event_type", "burst_pct", (~F.col("burst_pct").between(lo, hi)).alias("is_violation"))


def null_keys(streams: Streams) -> DataFrame:
    """Rows without client, time or item, per stream."""
    parts = []
    for kind, df in streams.by_type().items():
        item = df.columns[-1]
        rows = violations(
            df,
            null_client=F.col("client_id").isNull(),
            null_time=F.col("event_ts").isNull(),
            null_item=F.col(item).isNull(),
        )
        parts.append(rows.select(F.lit(kind).alias("event_type"), "*"))
    return together(*parts)


def product_range(products: DataFrame, lo: int = 0, hi: int = 99) -> DataFrame:
    out_of_range = violations(products, price_out_of_range=~F.col("price_bucket").between(lo, hi))
    return out_of_range.unionByName(key_uniqueness({"sku_repeated": (products, ["sku"])}))


def total_agreement(events: DataFrame, daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """The event total of the log, the daily and the weekly table."""
    raw = events.agg(F.count(F.lit(1))).scalar()
    d = daily.agg(F.sum("n_events_total")).scalar()
    return weekly.agg(F.sum("n_events_total").alias("n_weekly")).select(
        raw.alias("n_raw"), d.alias("n_daily"), "n_weekly"
    ).withColumn("is_violation", (F.col("n_raw") != F.col("n_daily")) | (F.col("n_raw") != F.col("n_weekly")))


def cart_customers(streams: Streams, cart: DataFrame) -> DataFrame:
    """Cart customers must be adders plus removers minus those who did both."""
    per_client = streams.events.groupBy("client_id").agg(
        F.max(F.col("event_type") == "add_to_cart").alias("adds"),
        F.max(F.col("event_type") == "remove_from_cart").alias("removes"),
    )
    sets = per_client.agg(
        F.count_if("adds").alias("n_add"),
        F.count_if("removes").alias("n_remove"),
        F.count_if(F.col("adds") & F.col("removes")).alias("n_both"),
    )
    n = cart.agg(F.count(F.lit(1))).scalar()
    return sets.withColumn("n_cart", n).withColumn(
        "is_violation", F.col("n_cart") != F.col("n_add") + F.col("n_remove") - F.col("n_both")
    )


def category_and_gap(categories: DataFrame, history: DataFrame) -> DataFrame:
    return violations(categories, null_category=F.col("category").isNull()).unionByName(
        violations(history, negative_gap=F.col("days_since_prev_purchase_occasion") < 0)
    )


def pooled_gap_agreement(history: DataFrame, gaps: DataFrame, mean_tol: float = 0.01, median_tol: float = 0.5) -> DataFrame:
    """Mean and median gap from the history table against the pooled gap counts."""
    first_rows = history.filter(F.col("days_since_prev_purchase_occasion").isNotNull())
    per_gap = (
        first_rows.groupBy("client_id", "purchase_occasion_seq")
        .agg(F.max("days_since_prev_purchase_occasion").alias("gap"))
        .groupBy("gap")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def centre(df):
        return df.agg(
            F.struct(
                (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("mean"), F.percentile("gap", 0.5, F.col("n")).alias("median")
            ).alias("c")
        )

    a, b = centre(per_gap), centre(gaps)
    return a.select("c", b.scalar().alias("p")).select(
        F.col("c.mean").alias("history_mean"),
        F.col("p.mean").alias("profile_mean"),
        F.col("c.median").alias("history_median"),
        F.col("p.median").alias("profile_median"),
        (
            (F.abs(F.col("c.mean") - F.col("p.mean")) > mean_tol)
            | (F.abs(F.col("c.median") - F.col("p.median")) > median_tol)
        ).alias("is_violation"),
    )


def rate_ranges(retention: DataFrame, categories: DataFrame, p: Params) -> DataFrame:
    """Rates inside [0, 1], and the last cohort's longest window cut off."""

    def outside(c):
        return ~F.col(c).between(0, 1)

    rates = {f"retention_{n}d_out_of_range": outside(f"repurchase_{n}d_rate") for n in p.retention_days}
    last = retention.agg(F.max("cohort_week")).scalar()
    flag = F.col(f"is_{max(p.retention_days)}d_window_censored")
    cohorts = retention.withColumn("_last", last)
    return violations(
        cohorts, **rates, last_cohort_not_censored=(F.col("cohort_week") == F.col("_last")) & ~flag
    ).unionByName(violations(categories, category_rate_out_of_range=outside("repurchase_rate")))


BUYER_STAGES = ("first_purchase", "returned", "active", "declining", "at_risk", "inactive")
VISITOR_STAGES = ("cart", "explorer")


def lifecycle_rules(lifecycle: DataFrame) -> DataFrame:
    stage, buyer = F.col("lifecycle_stage"), F.col("is_buyer")
    return violations(
        lifecycle,
        no_stage=stage.isNull() | (stage == "other"),
        buyer_in_visitor_stage=buyer & ~stage.isin(*BUYER_STAGES),
        visitor_in_buyer_stage=~buyer & ~stage.isin(*VISITOR_STAGES, "other"),
        negative_recency=F.col("days_since_last_purchase") < 0,
    )


SEGMENTS_OF_STAGE = {
    "explorer": ("high_intent_explorer", "low_intent_explorer"),
    "cart": ("cart_hold", "cart_abandon"),
    "first_purchase": ("first_purchase",),
    "active": ("steady_repeat",),
    "declining": ("declining_repeat",),
    "at_risk": ("lapsed",),
    "inactive": ("lapsed",),
    "returned": ("returned",),
    "other": ("other",),
}
SUBTYPES = ("no_removal_recorded", "fast_removal", "slow_removal")


def segment_rules(segments: DataFrame) -> DataFrame:
    stage, segment, sub = F.col("lifecycle_stage"), F.col("segment"), F.col("cart_removal_subtype")
    fits = F.lit(False)
    for name, allowed in SEGMENTS_OF_STAGE.items():
        fits = fits | ((stage == name) & segment.isin(*allowed))
    return violations(
        segments,
        segment_not_of_stage=~fits,
        subtype_outside_cart=(stage != "cart") & sub.isNotNull(),
        cart_without_subtype=(stage == "cart") & (sub.isNull() | ~sub.isin(*SUBTYPES)),
        hold_with_removal=(segment == "cart_hold") & (sub != "no_removal_recorded"),
        abandon_without_removal=(segment == "cart_abandon") & (sub == "no_removal_recorded"),
    )


def label_window(panel: DataFrame, streams: Streams, p: Params) -> DataFrame:
    """Panel rows whose longest label window runs past the end of the log."""
    end = midnight("snapshot_date") + days(max(p.label_days))
    return violations(panel.withColumn("_end", log_end(streams)), label_window_cut_off=end > F.col("_end"))


def window_order(snapshot: DataFrame, p: Params) -> DataFrame:
    """Purchase counts must not fall as the window grows, up to all purchases so far."""
    columns = [f"n_purchases_{n}d" for n in sorted(p.purchase_windows)] + ["n_purchase_occasions_so_far"]
    rules = {f"{a}_above_{b}": F.col(a) > F.col(b) for a, b in zip(columns, columns[1:])}
    return violations(snapshot, **rules)


def label_rules(snapshot: DataFrame, churn: DataFrame, p: Params) -> DataFrame:
    rules = {}
    for n in p.label_days:
        buys, idle = F.col(f"label_purchase_{n}d"), F.col(f"label_inactive_{n}d")
        rules[f"label_{n}d_not_0_or_1"] = ~buys.isin(0, 1)
        rules[f"inactive_{n}d_not_opposite"] = idle != (buys == 0)
    key = ["snapshot_date", "client_id"]
    both = snapshot.select(*key, *[f"label_inactive_{n}d" for n in p.label_days]).join(
        churn.select(*key, *[f"churn_{n}d" for n in p.label_days]), key, "full"
    )
    differs = {
        f"churn_{n}d_differs": ~F.col(f"churn_{n}d").eqNullSafe(F.col(f"label_inactive_{n}d")) for n in p.label_days
    }
    return violations(snapshot, **rules).unionByName(violations(both, **differs))


def category_growth(rates: DataFrame, p: Params) -> DataFrame:
    """Category customer counts must not fall from one snapshot to the next."""
    prev = F.lag("n_customers").over(Window.partitionBy("category").orderBy("snapshot_date"))
    return violations(
        rates.withColumn("_prev", prev),
        customers_fall=F.col("n_customers") < F.col("_prev"),
        below_min_sample=F.col("n_customers") < p.category_min_customers,
        more_repeaters_than_customers=F.col("n_repurchase_customers") > F.col("n_customers"),
    )


def history_rules(propensity: DataFrame, churn: DataFrame) -> DataFrame:
    """History flag against recency and category rate; every churn row is in the wider panel."""
    has, since = F.col("has_purchase_history"), F.col("days_since_last_purchase")
    key = ["snapshot_date", "client_id"]
    # a written panel is small on disk: by its size alone Spark would broadcast all of its keys
    lost = churn.select(*key).join(propensity.select(*key).hint("merge"), key, "left_anti")
    missing = lost.agg(F.count(F.lit(1)).alias("n_violations"))
    n = churn.agg(F.count(F.lit(1))).scalar()
    return violations(
        propensity,
        history_without_recency=has & since.isNull(),
        recency_without_history=~has & since.isNotNull(),
        rate_without_history=~has & F.col("avg_category_repurchase_rate").isNotNull(),
    ).unionByName(missing.select(F.lit("churn_row_not_in_propensity").alias("check_name"), n.alias("n_checked"), "n_violations"))


def targeting_rules(policies: DataFrame, rates: Sequence[int], tolerance: float = 0.01) -> DataFrame:
    """Selected share against the contact rate (or one row off in a small population)."""
    off = F.abs(F.col("n_selected") / F.col("n_total") - F.col("contact_rate_pct") / 100.0)
    share = off > F.greatest(F.lit(tolerance), F.lit(1.0) / F.col("n_total"))
    sizes = policies.groupBy("label", "split", "policy").agg(F.count_distinct("contact_rate_pct").alias("n_rates"))
    return violations(
        policies,
        selected_share_off=share,
        recall_out_of_range=~F.col("recall").between(0, 1),
        captured_above_selected=F.col("n_actual_captured") > F.col("n_selected"),
    ).unionByName(violations(sizes, rates_missing=F.col("n_rates") != len(rates)))


def policy_order(table: DataFrame, better: str, worse: str) -> DataFrame:
    """Contact rates at which one policy finds no more than another, and negative savings."""
    key = ["model", "label", "contact_rate_pct"]
    a = table.filter(F.col("policy") == better).select(*key, F.col("recall").alias("a"))
    b = table.filter(F.col("policy") == worse).select(*key, F.col("recall").alias("b"))
    versus = table.filter(F.col("contact_reduction_pct").isNotNull())
    return violations(a.join(b, key), not_above_worse_policy=F.col("a") <= F.col("b")).unionByName(
        violations(versus, negative_reduction=F.col("contact_reduction_pct") < 0)
    )


def split_rules(tagged: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Splits must follow each other in time, cover every row, and share no label with the features."""
    spans = tagged.groupBy("split").agg(F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi"))
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    prev = F.max("hi").over(Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    leaked = len(set(features) & set(labels))
    return violations(tagged, row_without_split=F.col("split").isNull(), label_among_features=F.lit(leaked > 0)).unionByName(
        violations(spans.withColumn("_prev", prev), split_overlaps_earlier=F.col("lo") <= F.col("_prev"))
    )


def distribution_rules(shares: DataFrame, notes: DataFrame) -> DataFrame:
    """Shares add up to 100 and every segment has its notes."""
    total = shares.agg(F.sum("pct").alias("pct"))
    return violations(total, shares_not_100=F.abs(F.col("pct") - 100) > 0.01).unionByName(
        violations(
            notes,
            notes_missing=F.col("crm_purpose").isNull() | F.col("priority").isNull() | F.col("recommended_action").isNull(),
        )
    )


def funnel_rules(reach: DataFrame, customers: DataFrame, streams: Streams) -> DataFrame:
    """A later funnel step is never larger; the first purchase is the earliest one."""
    w = Window.partitionBy(F.lit(1)).orderBy("step")
    steps = reach.withColumn("_prev", F.lag("n_customers").over(w))
    firsts = streams.buy.groupBy("client_id").agg(F.min("event_ts").alias("_first"))
    buyers = customers.filter("is_buyer").join(firsts, "client_id", "full")
    return violations(steps, step_grows=F.col("n_customers") > F.col("_prev")).unionByName(
        violations(
            buyers,
            first_purchase_differs=~F.col("first_purchase_ts").eqNullSafe(F.col("_first")),
            first_purchase_after_last=day("first_purchase_ts") > day("last_purchase_ts"),
        )
    )
