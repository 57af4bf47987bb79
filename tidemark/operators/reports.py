"""Funnel, cohort, segment and distribution tables built from the customer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import count_where, days_between, ratio, seconds_between
from ..params import Params
from ..plans.joins import spread_lookup
from ..sources.streams import Streams
from .facts import cart_pairs, gap_counts, log_end
from .marts import _customer_360, customer_segment, segmented_customers, staged_customers
from .panel import category_starts
from .profile import as_metrics, quantiles_of

def explores() -> Column:
    return (F.col("n_page_visit") > 0) | (F.col("n_search_query") > 0)


# --- funnel ------------------------------------------------------------------------------


def funnel_reach(customers: DataFrame) -> DataFrame:
    """Customers left at each step when every step also needs the ones before."""
    cart, buyer = F.col("has_cart_activity"), F.col("is_buyer")
    counts = customers.agg(
        F.count(F.lit(1)).alias("all"),
        count_where(explores()).alias("explore"),
        count_where(explores() & cart).alias("cart"),
        count_where(explores() & cart & buyer).alias("buy"),
    )
    none = F.lit(None).cast("double")
    steps = [
        ("all_customers", "all", none),
        ("explore", "explore", none),
        ("explore_cart", "cart", ratio("cart", "explore", 100)),
        ("explore_cart_buy", "buy", ratio("buy", "cart", 100)),
    ]
    rows = [
        F.struct(
            F.lit(k + 1).alias("step"),
            F.lit(name).alias("stage"),
            F.col(c).alias("n_customers"),
            ratio(c, "all", 100).alias("pct_of_total"),
            prev.alias("pct_of_prev_stage"),
        )
        for k, (name, c, prev) in enumerate(steps)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def buyer_paths(customers: DataFrame) -> DataFrame:
    """Customers per (explored, used a cart, bought); shares are of all buyers."""
    paths = customers.groupBy(
        explores().alias("has_explore"), F.col("has_cart_activity").alias("has_cart"), "is_buyer"
    ).agg(F.count(F.lit(1)).alias("n_customers"))
    buyers = F.sum("n_customers").over(Window.partitionBy("is_buyer"))
    return paths.withColumn("pct_of_buyers", F.when(F.col("is_buyer"), ratio(F.col("n_customers"), buyers, 100)))


def repeat_vs_single(customers: DataFrame) -> DataFrame:
    group = F.when(F.col("n_purchase_days") == 1, "one_purchase_day").otherwise("two_or_more_days")
    return customers.filter("is_buyer").groupBy(group.alias("group_name")).agg(F.count(F.lit(1)).alias("n_customers"))


def _funnel(customers: DataFrame) -> DataFrame:
    cart, buyer = F.col("has_cart_activity"), F.col("is_buyer")
    return customers.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(explores()).alias("explore"),
        count_where(cart).alias("cart"),
        count_where(buyer).alias("buy"),
        count_where(explores() & cart).alias("explore_to_cart"),
        count_where(cart & buyer).alias("cart_to_buy"),
        count_where(buyer & ~cart & ~explores()).alias("buy_with_no_footprint"),
    )


def funnel_summary(customers: DataFrame) -> DataFrame:
    """Customers per action, each counted on its own."""
    return as_metrics(_funnel(customers), "stage_metric")


def overview_kpis(streams: Streams, propensity: DataFrame, p: Params) -> DataFrame:
    """Head counts, and how many of the latest snapshot went on to buy."""
    return as_metrics(_kpis(streams, propensity, p))


def _kpis(streams: Streams, propensity: DataFrame, p: Params) -> DataFrame:
    stage = F.col("lifecycle_stage")
    people = staged_customers(streams, p).agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_where(F.col("is_buyer")).alias("buyers"),
        count_where(F.col("is_repeat_capable")).alias("repeat_buyers"),
        count_where(F.col("has_cart_activity")).alias("cart_customers"),
        count_where(stage == "at_risk").alias("at_risk_customers"),
        count_where(stage == "inactive").alias("inactive_customers"),
    )
    converted = propensity.groupBy("snapshot_date").agg(
        F.sum(f"will_purchase_{min(p.label_days)}d").cast("bigint").alias("n")
    )
    latest = converted.agg(F.coalesce(F.max_by("n", "snapshot_date"), F.lit(0))).scalar()
    return people.withColumn("recent_converters", latest)


def stage_rates(customers: DataFrame) -> DataFrame:
    """Shares between the funnel's actions; NULL where the base is empty."""
    return as_metrics(
        _funnel(customers).select(
            ratio("explore", "total", 100).alias("explore_pct_of_total"),
            ratio("cart", "total", 100).alias("cart_pct_of_total"),
            ratio("buy", "total", 100).alias("buy_pct_of_total"),
            ratio("cart", "explore", 100).alias("cart_pct_of_explore_stage"),
            ratio("buy", "cart", 100).alias("buy_pct_of_cart_stage"),
            ratio("explore_to_cart", "explore", 100).alias("explore_to_cart_rate"),
            ratio("cart_to_buy", "cart", 100).alias("cart_to_buy_rate"),
            ratio("buy_with_no_footprint", "buy", 100).alias("no_footprint_pct_of_buyers"),
        )
    )


# --- stages and segments -----------------------------------------------------------------


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column`` with the share of all, to 4 places."""
    per_value = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return per_value.withColumn("pct", F.round(ratio(F.col("n"), total, 100), 4))


def segment_profile(streams: Streams, p: Params) -> DataFrame:
    return segmented_customers(streams, p).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("is_buyer").cast("double")).alias("buy_rate"),
        F.avg("n_page_visit").alias("avg_visit"),
        F.avg("n_search_query").alias("avg_search"),
        F.avg("n_purchases").alias("avg_purchases"),
        F.avg("avg_purchase_gap_days").alias("avg_gap_days"),
    )


# Purpose, action, contact priority and risk of contacting too often.
SEGMENT_NOTES = (
    ("low_intent_explorer", "conversion, low yield", "brand display and retargeting", "lowest", "very high"),
    ("high_intent_explorer", "conversion", "reminder of viewed categories, promotion", "high", "medium"),
    ("cart_abandon", "cart recovery", "suggest alternatives, strong promotion", "very high", "low to medium"),
    ("cart_hold", "checkout completion", "light cart reminder, low-stock notice", "high", "low"),
    ("first_purchase", "second purchase", "onboarding, related items, second-order discount", "high", "low"),
    ("steady_repeat", "retention and loyalty", "loyalty programme, early access", "high (retention)", "very low"),
    ("declining_repeat", "early re-engagement", "light reminder, new arrivals", "high", "low"),
    ("lapsed", "win-back", "strong promotion, survey on reasons", "medium", "medium"),
    ("returned", "keep the returned", "welcome back, guard against a second lapse", "high", "low to medium"),
)
PRIORITY_RANK = {"very high": 5, "high (retention)": 4, "high": 4, "medium": 3, "low": 2, "lowest": 1}
CONTACT_RISK_RANK = {"very low": 1, "low": 2, "low to medium": 3, "medium": 4, "high": 5, "very high": 6}
HIGH_PRIORITIES = ("very high", "high", "high (retention)")
STAGE_TONE = {
    "inactive": "danger",
    "at_risk": "warning",
    "declining": "warning",
    "active": "positive",
    "returned": "positive",
    "first_purchase": "positive",
}


def _lookup(column: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def with_segment_notes(profile: DataFrame) -> DataFrame:
    """Attach the nine fixed notes as expressions; no join is needed for so few."""
    seg = F.col("segment")
    fields = ("crm_purpose", "recommended_action", "priority", "over_contact_risk")
    return profile.select(
        "*",
        *[_lookup(seg, {n[0]: n[k + 1] for n in SEGMENT_NOTES}, None).alias(f) for k, f in enumerate(fields)],
    )


def action_list(profile: DataFrame) -> DataFrame:
    """Segments by priority, then by how safely they can be contacted."""
    ranked = with_segment_notes(profile).select(
        "*",
        _lookup(F.col("priority"), PRIORITY_RANK, 0).alias("priority_rank"),
        _lookup(F.col("over_contact_risk"), CONTACT_RISK_RANK, 99).alias("over_contact_rank"),
    )
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("priority_rank").desc(), "over_contact_rank", "segment")
    return ranked.select(
        F.row_number().over(order).alias("position"),
        "segment",
        "n",
        "priority",
        "priority_rank",
        "over_contact_risk",
        "over_contact_rank",
        "recommended_action",
    )


def stage_groups(lifecycle: DataFrame) -> DataFrame:
    tone = _lookup(F.col("lifecycle_stage"), STAGE_TONE, "neutral")
    return distribution(lifecycle.select(tone.alias("tone")), "tone")


def uncensored_retention(retention: DataFrame, p: Params) -> DataFrame:
    """Plain mean of the cohorts whose longest window lies inside the log."""
    whole = retention.filter(~F.col(f"is_{max(p.retention_days)}d_window_censored"))
    return whole.agg(
        F.count(F.lit(1)).alias("n_cohorts"),
        *[F.avg(f"repurchase_{n}d_rate").alias(f"mean_repurchase_{n}d_rate") for n in p.retention_days],
    )


def cart_split(segments: DataFrame) -> DataFrame:
    rows = segments.filter(F.col("segment").isin("cart_hold", "cart_abandon"))
    group = (
        F.when(F.col("segment") == "cart_hold", "hold")
        .when(F.col("cart_removal_subtype") == "fast_removal", "abandon_fast")
        .otherwise("abandon_slow")
    )
    return distribution(rows.select(group.alias("cart_group")), "cart_group")


# --- distributions -----------------------------------------------------------------------


def daily_event_volume(daily: DataFrame) -> DataFrame:
    kinds = ("page_visit", "search_query", "add_to_cart", "remove_from_cart", "product_buy")
    return daily.groupBy("activity_date").agg(*[F.sum(f"n_{k}").alias(k) for k in kinds])


def event_count_histogram(customers: DataFrame, edges: int = 60) -> DataFrame:
    """Clients per bin of total events, bins evenly wide on a log scale; removals not counted."""
    total = F.col("n_page_visit") + F.col("n_search_query") + F.col("n_add_to_cart") + F.col("n_purchases")
    counted = customers.groupBy(total.alias("total_events")).agg(F.count(F.lit(1)).alias("c")).filter("total_events > 0")
    bins = edges - 1
    top = counted.agg(F.log10(F.max("total_events"))).scalar()
    place = F.when(F.col("top") > 0, F.floor(F.log10("total_events") / F.col("top") * bins)).otherwise(F.lit(0))
    return (
        counted.withColumn("top", top)
        .groupBy(F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"), "top")
        .agg(F.sum("c").alias("n_clients"))
        .select(
            "bin",
            F.pow(F.lit(10.0), F.col("top") * F.col("bin") / bins).alias("lower_edge"),
            F.pow(F.lit(10.0), F.col("top") * (F.col("bin") + 1) / bins).alias("upper_edge"),
            "n_clients",
        )
    )


def gap_histogram(buy: DataFrame, width: int = 3, top: int = 180) -> DataFrame:
    """Day gaps between occasions in bins up to ``top`` (last bin closed), with p50 and p90 of all."""
    counted = gap_counts(buy)
    q = counted.agg(quantiles_of(counted, "gap", "n", (0.5, 0.9))).scalar()
    place = F.least(F.floor(F.col("gap") / width), F.lit(top // width - 1))
    return (
        counted.filter(F.col("gap") <= top)
        .groupBy((place * width).cast("bigint").alias("from_day"))
        .agg(F.sum("n").alias("n_gaps"))
        .withColumn("q", q)
        .select("from_day", "n_gaps", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"))
    )


def price_bucket_rates(streams: Streams) -> DataFrame:
    """Per price bucket: added (client, item) pairs, those bought after, those removed."""
    pairs = cart_pairs(streams).filter((F.col("n_add") > 0) & F.col("sku").isNotNull())
    rows = spread_lookup(pairs, streams.products.select("sku", "price_bucket"), ["sku"], ["client_id"])
    return (
        rows.groupBy("price_bucket")
        .agg(
            F.count(F.lit(1)).alias("n_added"),
            count_where(F.col("first_buy_ts") >= F.col("first_add_ts")).alias("n_converted"),
            count_where(F.col("n_remove") > 0).alias("n_removed"),
        )
        .select(
            "*",
            ratio("n_converted", "n_added", 100).alias("conversion_rate"),
            ratio("n_removed", "n_added", 100).alias("removal_rate"),
        )
    )


def category_repurchase_z(streams: Streams, p: Params) -> DataFrame:
    """Share of a category's customers who came back, and how far from the mean category."""
    rates = (
        category_starts(streams)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n_customers"), F.count("second_ts").alias("n_repurchase_customers"))
        .filter(F.col("n_customers") >= p.category_min_customers)
        .withColumn("repurchase_rate", F.col("n_repurchase_customers") / F.col("n_customers"))
    )
    mean = rates.agg(F.avg("repurchase_rate")).scalar()
    p0 = F.col("mean_rate")
    z = (F.col("repurchase_rate") - p0) / F.sqrt(p0 * (1 - p0) / F.col("n_customers"))
    return rates.withColumn("mean_rate", mean).withColumn("z", F.when((p0 > 0) & (p0 < 1), z))


def first_action_conversion(streams: Streams, p: Params) -> DataFrame:
    """Purchase rate by which came first, search or visit. The groups overlap by design."""
    visits, searches = F.col("n_page_visit"), F.col("n_search_query")
    both = (searches > 0) & (visits > 0)
    search_first = both & (F.col("first_search_ts") < F.col("first_visit_ts"))
    few = visits < p.high_intent_visits
    groups = {
        "search_only": (searches > 0) & (visits == 0),
        "visit_first_few_visits": both & ~search_first & few,
        "search_first_few_visits": search_first & few,
        "search_first": search_first,
    }
    names = F.array(*[F.when(cond, name) for name, cond in groups.items()])
    return (
        _customer_360(streams, p)
        .select(F.explode(names).alias("first_action"), F.col("is_buyer").cast("double").alias("bought"))
        .filter(F.col("first_action").isNotNull())
        .groupBy("first_action")
        .agg(F.count(F.lit(1)).alias("n_customers"), (F.avg("bought") * 100).alias("conversion_pct"))
    )


VISIT_BANDS = tuple((str(k), k, k) for k in range(1, 10)) + (
    ("10-14", 10, 14),
    ("15-19", 15, 19),
    ("20-29", 20, 29),
    ("30-49", 30, 49),
    ("50-99", 50, 99),
)


def visit_band_conversion(customers: DataFrame) -> DataFrame:
    """Purchase rate by number of visits among clients who never searched."""
    band = F.lit("100+")
    for name, lo, hi in VISIT_BANDS:
        band = F.when(F.col("n_page_visit").between(lo, hi), name).otherwise(band)
    return (
        customers.filter((F.col("n_search_query") == 0) & (F.col("n_page_visit") > 0))
        .groupBy(band.alias("visit_band"))
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            (F.avg(F.col("is_buyer").cast("double")) * 100).alias("conversion_pct"),
        )
    )


def label_rates(panel: DataFrame, labels: Sequence[str]) -> DataFrame:
    return panel.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("n_population"),
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in labels],
    )


def removal_gap_histogram(streams: Streams) -> DataFrame:
    """Seconds from first add to the removal after it, in half decades (bin 4 = 100 s to 316 s)."""
    secs = seconds_between("first_add_ts", "remove_after_add_ts")
    pairs = cart_pairs(streams).filter(F.col("remove_after_add_ts").isNotNull() & F.col("sku").isNotNull())
    place = F.when(secs >= 1, F.floor(F.log10(secs) * 2)).otherwise(F.lit(-1))
    return pairs.groupBy(place.cast("bigint").alias("half_decade")).agg(F.count(F.lit(1)).alias("n_pairs"))


def cart_hold_summary(streams: Streams, p: Params) -> DataFrame:
    """Clients who keep a cart without removing: days since the last add, items, single items."""
    holders = customer_segment(streams, p).filter(F.col("segment") == "cart_hold").select("client_id")
    carts = (
        cart_pairs(streams)
        .filter(F.col("n_add") > 0)
        .groupBy("client_id")
        .agg(F.max("last_add_ts").alias("last_add"), F.count("sku").alias("n_items"))
    )
    rows = holders.join(carts, "client_id").select(
        days_between("last_add", log_end(streams)).alias("days_left"), "n_items"
    )
    counted = rows.groupBy("days_left").agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("n_items") == 1).alias("single")
    )
    return counted.agg(
        F.sum("n").alias("n_clients"),
        F.percentile("days_left", 0.5, F.col("n")).alias("median_days_left"),
        ratio(F.sum(F.when(F.col("days_left") > p.right_censor_days, F.col("n"))), F.sum("n"), 100).alias(
            "pct_with_time_left"
        ),
        ratio(F.sum("single"), F.sum("n"), 100).alias("pct_single_item"),
    )


# --- report facts ------------------------------------------------------------------------


def report_facts(kpis: DataFrame, segments: DataFrame, policies: DataFrame, contact_rate: int = 10) -> DataFrame:
    """All numbers a written report may use, as ``(kind, subject, metric, value)``.

    ``kpis`` are ``(metric, value)`` rows, ``segments`` a profile with notes, ``policies``
    the policy table.
    """
    keep = ("total_customers", "buyers", "at_risk_customers", "inactive_customers")
    data = kpis.filter(F.col("metric").isin(*keep)).select(
        F.lit("data").alias("kind"), F.lit("all").alias("subject"), "metric", "value"
    )
    seg = (
        segments.filter(F.col("priority").isin(*HIGH_PRIORITIES))
        .select("segment", F.col("n").cast("double").alias("n_customers"), "buy_rate")
        .unpivot(["segment"], ["n_customers", "buy_rate"], "metric", "value")
        .select(F.lit("segment").alias("kind"), F.col("segment").alias("subject"), "metric", "value")
    )
    pol = (
        policies.filter(F.col("contact_rate_pct") == contact_rate)
        .select(F.concat_ws("/", "label", "policy").alias("subject"), "recall", "lift", "precision")
        .unpivot(["subject"], ["recall", "lift", "precision"], "metric", "value")
        .select(F.lit("policy").alias("kind"), "subject", "metric", "value")
    )
    return data.unionByName(seg).unionByName(pol)


RATES = ("buy_rate", "recall", "precision")


def fact_problems(facts: DataFrame) -> DataFrame:
    """Facts that are missing, not a number, negative, or a rate above 1."""
    v = F.col("value")
    problem = (
        F.when(v.isNull() | F.isnan(v), "missing")
        .when(v < 0, "negative")
        .when(F.col("metric").isin(*RATES) & (v > 1), "rate_above_one")
    )
    return facts.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def fact_check(facts: DataFrame) -> DataFrame:
    """Facts checked and rejected per kind."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (v < 0) | (F.col("metric").isin(*RATES) & (v > 1))
    return facts.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_facts"), count_where(F.coalesce(bad, F.lit(True))).alias("n_rejected")
    )


def period_problems(periods: DataFrame) -> DataFrame:
    """Report periods that end before they start."""
    return periods.filter(F.col("period_end") < F.col("period_start"))


# Claims of measured success that a report must not make.
BANNED_CLAIMS = (
    "매출을 개선",
    "매출을 증가",
    "매출이 개선",
    "매출이 증가",
    "이탈률을 개선",
    "이탈률이 개선",
    "전환율을 향상",
    "전환율이 향상",
    "캠페인 효과를 검증",
    "실제로 이탈률",
    "ROI를 개선",
    "실제 매출",
)


def banned_claim(text: str | Column, phrases: Sequence[str] = BANNED_CLAIMS) -> Column:
    """The first phrase of the list that the text holds, else NULL."""
    body = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.when(F.contains(body, F.lit(x)), F.lit(x)) for x in phrases])


def banned_claims(texts: DataFrame, key: Sequence[str], text: str, phrases: Sequence[str] = BANNED_CLAIMS) -> DataFrame:
    return texts.select(*key, banned_claim(text, phrases).alias("banned_phrase"))

