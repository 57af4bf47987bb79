"""Data-quality profiles of the event log and the product table.

Medians and percentiles of counts are taken over (value, how often) pairs, which are few,
instead of over the clients themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import count_where, day, days, epoch_second, ratio, seconds_between
from ..params import Params
from ..plans.joins import spread_lookup
from ..plans.materialize import materialize
from ..plans.ranking import counted_quantiles
from ..plans.rollup import EVENT_TYPES
from ..sources.streams import Streams
from .facts import cart_pairs, daily_activity, log_end, log_start, observation_period
from .marts import purchase_days
from .staging import staged_flags

TYPE_BIT = {name: 1 << n for n, name in enumerate(EVENT_TYPES)}


def as_metrics(one_row: DataFrame, name: str = "metric") -> DataFrame:
    """A one-row frame as ``(metric, value)`` rows."""
    wide = one_row.select(*[F.col(c).cast("double").alias(c) for c in one_row.columns])
    return wide.unpivot([], wide.columns, name, "value")


def quantiles_of(counted: DataFrame, value: str, n: str, probs: Sequence[float]) -> Column:
    """Interpolated percentiles of ``value`` weighted with the count column ``n``."""
    return F.percentile(value, F.array(*[F.lit(float(q)) for q in probs]), F.col(n))


def spread_of(rows: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Per column: rows, mean, min, max and percentiles; one row per ``metric``."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "value")
    counted = long.filter(F.col("value").isNotNull()).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    q = counted.groupBy("metric").agg(
        F.sum("n").alias("n_rows"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        quantiles_of(counted, "value", "n", probs).alias("q"),
    )
    return q.select(
        "metric",
        "n_rows",
        "mean",
        "min",
        "max",
        *[F.col("q")[k].alias("p" + f"{100 * x:g}".replace(".", "")) for k, x in enumerate(probs)],
    )


# --- tables ------------------------------------------------------------------------------


def table_profile(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Per column: type, rows, NULLs and distinct values; estimated distincts if not exact."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for k, c in enumerate(df.columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{k}"), distinct(F.col(c)).alias(f"distinct_{k}")]
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(dict(df.dtypes)[c]).alias("data_type"),
            F.col(f"null_{k}").alias("n_null"),
            F.col(f"distinct_{k}").alias("n_distinct"),
        )
        for k, c in enumerate(df.columns)
    ]
    return (
        df.agg(*aggs)
        .select("n_rows", F.explode(F.array(*per_column)).alias("c"))
        .select(
            F.lit(name).alias("table_name"),
            "c.column_name",
            "c.data_type",
            "n_rows",
            "c.n_null",
            ratio("c.n_null", "n_rows").alias("null_pct"),
            "c.n_distinct",
        )
    )


def duplicated_rows(df: DataFrame) -> DataFrame:
    """How many distinct row values occur more than once, and how many rows they make up."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .agg(
            F.count(F.lit(1)).alias("n_duplicated_values"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows_in_duplicates"),
        )
    )


def key_uniqueness(df: DataFrame, key: Sequence[str]) -> DataFrame:
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct_keys"),
        F.coalesce(F.max("n") <= 1, F.lit(True)).alias("is_unique"),
    )


def edge_rows(df: DataFrame, key: Sequence[str], n: int = 5, last: bool = False) -> DataFrame:
    """The first (or last) rows by key; file order means nothing."""
    return df.orderBy(*[F.col(c).desc() if last else F.col(c).asc() for c in key]).limit(n)


# --- events ------------------------------------------------------------------------------


def timestamp_audit(events: DataFrame, cutoff: str) -> DataFrame:
    """Per type: unreadable times, span, clients, and rows from ``cutoff`` on."""
    late = F.col("event_ts") >= F.lit(cutoff).cast("timestamp_ntz")
    per_client = events.groupBy("event_type", "client_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_ts").isNull()).alias("bad"),
        F.min("event_ts").alias("lo"),
        F.max("event_ts").alias("hi"),
        F.count_if(late).alias("late"),
    )
    per_type = per_client.groupBy("event_type").agg(
        F.sum("n").alias("row_count"),
        F.sum("bad").alias("parse_fail_count"),
        F.min("lo").alias("min_ts"),
        F.max("hi").alias("max_ts"),
        F.count("client_id").alias("unique_clients"),
        F.sum("late").alias("rows_after_cutoff"),
    )
    return per_type.select(
        "*",
        F.extract(F.lit("DAY"), F.col("max_ts") - F.col("min_ts")).cast("bigint").alias("observation_days"),
        ratio("rows_after_cutoff", "row_count", 100).alias("pct_after_cutoff"),
    )


def presence_masks(events: DataFrame) -> DataFrame:
    """Number of clients per set of event types, the set being a 5-bit mask."""
    bit = F.lit(0)
    for name, value in TYPE_BIT.items():
        bit = F.when(F.col("event_type") == name, value).otherwise(bit)
    return (
        events.groupBy("client_id")
        .agg(F.bit_or(bit).alias("mask"))
        .groupBy("mask")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _clients_with(*kinds: str) -> Column:
    want = sum(TYPE_BIT[k] for k in kinds)
    return F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(want) == want, F.col("n"))), F.lit(0))


PAIRS = {
    "buy_and_cart": ("product_buy", "add_to_cart"),
    "buy_and_search": ("product_buy", "search_query"),
    "buy_and_pagevisit": ("product_buy", "page_visit"),
    "cart_and_remove": ("add_to_cart", "remove_from_cart"),
}


def _overlap(events: DataFrame) -> DataFrame:
    return presence_masks(events).agg(
        *[_clients_with(k).alias(f"unique_clients_{k}") for k in EVENT_TYPES],
        F.sum("n").alias("total_unique_clients_union"),
        *[_clients_with(*pair).alias(f"intersect_{name}") for name, pair in PAIRS.items()],
        _clients_with(*EVENT_TYPES).alias("clients_with_all_5_events"),
        F.coalesce(F.sum(F.when(F.bit_count("mask") == 1, F.col("n"))), F.lit(0)).alias(
            "clients_with_only_1_event_type"
        ),
    )


def client_overlap(events: DataFrame) -> DataFrame:
    return as_metrics(_overlap(events))


def client_overlap_shares(events: DataFrame) -> DataFrame:
    """Types as % of all clients, pairs as % of their first type, all five as % of both."""
    o = _overlap(events)
    total = "total_unique_clients_union"
    first = {name: f"unique_clients_{pair[0]}" for name, pair in PAIRS.items()}
    return as_metrics(
        o.select(
            *[ratio(f"unique_clients_{k}", total, 100).alias(f"pct_clients_{k}") for k in EVENT_TYPES],
            *[ratio(f"intersect_{name}", first[name], 100).alias(f"pct_{name}") for name in PAIRS],
            ratio("clients_with_all_5_events", total, 100).alias("pct_all_5_of_clients"),
            ratio("clients_with_all_5_events", "unique_clients_product_buy", 100).alias("pct_all_5_of_buyers"),
        )
    )


def event_type_distribution(events: DataFrame) -> DataFrame:
    per_size = presence_masks(events).groupBy(F.bit_count("mask").cast("bigint").alias("n_event_types")).agg(
        F.sum("n").alias("n_clients")
    )
    # at most one row per set size
    total = F.sum("n_clients").over(Window.partitionBy(F.lit(1)))
    return per_size.withColumn("pct", ratio(F.col("n_clients"), total, 100))


def product_match(streams: Streams) -> DataFrame:
    """Distinct items per cart and buy stream and how many of them have a product row."""
    items = (
        streams.events.filter(F.col("sku").isNotNull())
        .select("event_type", "sku")
        .distinct()
    )
    known = streams.products.select("sku").distinct().withColumn("known", F.lit(True))
    return (
        items.join(known, "sku", "left")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n_distinct_sku"), F.count("known").alias("n_matched_sku"))
        .withColumn("match_rate_pct", ratio("n_matched_sku", "n_distinct_sku", 100))
    )


def product_attributes(products: DataFrame) -> DataFrame:
    """NULLs, repeated and contradicting items, and the price-bucket range."""
    attrs = ("category", "price_bucket", "name_embedding")
    per_sku = products.groupBy("sku").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in attrs],
        *[F.min(c).alias(f"lo_{c}") for c in attrs[:2]],
        *[F.max(c).alias(f"hi_{c}") for c in attrs[:2]],
    )
    differs = (F.col("lo_category") < F.col("hi_category")) | (F.col("lo_price_bucket") < F.col("hi_price_bucket"))
    buckets = products.agg(F.count_distinct("price_bucket")).scalar()
    out = per_sku.agg(
        F.sum("n").alias("n_rows"),
        F.count("sku").alias("n_distinct_sku"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in attrs],
        F.count_if(F.col("n") > 1).alias("sku_with_multiple_rows"),
        F.count_if(differs).alias("sku_with_conflicting_attributes"),
        F.min("lo_price_bucket").alias("price_min"),
        F.max("hi_price_bucket").alias("price_max"),
    )
    return as_metrics(
        out.select(
            "*",
            *[ratio(f"null_{c}", "n_rows", 100).alias(f"null_{c}_pct") for c in attrs],
            buckets.alias("price_distinct_count"),
        )
    )


def events_per_client(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "client_id").agg(F.count(F.lit(1)).alias("n"))


def events_per_client_distribution(events: DataFrame) -> DataFrame:
    probs = (0.5, 0.9, 0.95, 0.99, 0.999)
    counted = events_per_client(events).groupBy("event_type", "n").agg(F.count(F.lit(1)).alias("c"))
    q = counted.groupBy("event_type").agg(
        F.min("n").alias("min_events_per_client"),
        (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean_events_per_client"),
        F.max("n").alias("max_events_per_client"),
        quantiles_of(counted, "n", "c", probs).alias("q"),
    )
    names = ("p50", "p90", "p95", "p99", "p999")
    return q.select("*", *[F.col("q")[k].alias(x) for k, x in enumerate(names)]).drop("q")


def heaviest_clients(events: DataFrame, p: Params) -> DataFrame:
    """The clients with most events per type; equal counts go by client id."""
    w = Window.partitionBy("event_type").orderBy(F.col("n").desc(), "client_id")
    return events_per_client(events).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= p.top_clients)


def burst_rate(streams: Streams, p: Params) -> DataFrame:
    return (
        staged_flags(streams, p)
        .groupBy("event_type")
        .agg(count_where(F.col("is_burst_repeat")).alias("burst_event_count"), F.count(F.lit(1)).alias("total_rows"))
        .withColumn("burst_pct", ratio("burst_event_count", "total_rows", 100))
    )


def observation_summary(streams: Streams, p: Params) -> DataFrame:
    obs = observation_period(streams, p)
    active = spread_of(obs, ["n_active_days"], [0.5])
    edges = obs.agg(
        F.struct(
            F.min("first_event_ts").alias("first_ts_min"),
            F.max("first_event_ts").alias("first_ts_max"),
            F.min("last_event_ts").alias("last_ts_min"),
            F.max("last_event_ts").alias("last_ts_max"),
        )
    ).scalar()
    return active.withColumn("edges", edges).select(
        "edges.*",
        F.col("p50").alias("median_active_days"),
        F.col("mean").alias("mean_active_days"),
        F.col("max").alias("max_active_days"),
        F.col("n_rows").alias("n_clients"),
    )


def daily_volume(events: DataFrame) -> DataFrame:
    """Spread of events per day and type, with the fullest and emptiest day (earliest on a tie)."""
    per_day = events.groupBy("event_type", day("event_ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    since = F.unix_date("d")
    return per_day.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_observed_days"),
        F.avg("n").alias("mean_daily_count"),
        F.stddev_samp("n").alias("std_daily_count"),
        F.max_by("d", F.struct("n", -since)).alias("max_day"),
        F.max("n").alias("max_day_count"),
        F.min_by("d", F.struct("n", since)).alias("min_day"),
        F.min("n").alias("min_day_count"),
    )


def observation_distribution(streams: Streams, p: Params) -> DataFrame:
    obs = observation_period(streams, p)
    days_seen = spread_of(obs, ["observation_days"], [0.5, 0.9, 0.95]).select(
        F.col("n_rows").alias("n_clients"),
        F.col("min").alias("obs_days_min"),
        F.col("mean").alias("obs_days_mean"),
        F.col("p50").alias("obs_days_median"),
        F.col("p90").alias("obs_days_p90"),
        F.col("p95").alias("obs_days_p95"),
        F.col("max").alias("obs_days_max"),
    )
    flags = obs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("observation_days") == 0).alias("obs_days_zero_count"),
        F.count_if("is_left_censor_candidate").alias("left_censor_candidates"),
        F.count_if("is_right_censor_candidate").alias("right_censor_candidates"),
    ).select(
        "obs_days_zero_count",
        ratio("obs_days_zero_count", "n", 100).alias("obs_days_zero_pct"),
        "left_censor_candidates",
        ratio("left_censor_candidates", "n", 100).alias("left_censor_pct"),
        "right_censor_candidates",
        ratio("right_censor_candidates", "n", 100).alias("right_censor_pct"),
    )
    return as_metrics(days_seen).unionByName(as_metrics(flags))


def buyer_censoring(streams: Streams, p: Params) -> DataFrame:
    """Buyers whose first purchase lies at the start, or last at the end, of the whole log."""
    lo, hi = log_start(streams), log_end(streams)
    buyers = streams.buy.groupBy("client_id").agg(F.min("event_ts").alias("first"), F.max("event_ts").alias("last"))
    out = buyers.select(
        (F.col("first") < lo + days(p.left_censor_days)).alias("early"),
        (F.col("last") >= hi - days(p.right_censor_days)).alias("late"),
    ).agg(
        F.count(F.lit(1)).alias("n_buyers"),
        F.count_if("early").alias("buyers_first_purchase_in_left_window"),
        F.count_if("late").alias("buyers_last_purchase_in_right_window"),
    )
    return as_metrics(
        out.select(
            "*",
            ratio("buyers_first_purchase_in_left_window", "n_buyers", 100).alias("left_window_pct"),
            ratio("buyers_last_purchase_in_right_window", "n_buyers", 100).alias("right_window_pct"),
        )
    )


# --- purchases, carts, searches -----------------------------------------------------------


def buyer_summary(buy: DataFrame, products: DataFrame) -> DataFrame:
    """Purchases, days, items and categories per buyer: mean, median; 1 / 2+ / 3+ day shares."""
    per_sku = buy.groupBy("client_id", "sku").agg(F.count(F.lit(1)).alias("n"))
    per_client = (
        spread_lookup(per_sku, products.select("sku", "category").distinct(), ["sku"], ["client_id"], how="left")
        .groupBy("client_id")
        .agg(
            F.sum("n").alias("purchases"),
            F.count("sku").alias("unique_skus"),
            F.count_distinct("category").alias("categories"),
        )
    )
    day_counts = purchase_days(buy).withColumnRenamed("n_purchase_days", "purchase_days")
    kinds = ["purchases", "purchase_days", "unique_skus", "categories"]
    rows = per_client.join(day_counts, "client_id")
    spread = spread_of(rows, kinds, [0.5])
    stats = spread.select(
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("mean_"), "metric").alias("metric"), F.col("mean").alias("value")),
                F.struct(F.concat(F.lit("median_"), "metric").alias("metric"), F.col("p50").alias("value")),
            )
        ).alias("m")
    ).select("m.metric", "m.value")
    shares = day_counts.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("purchase_days") == 1).alias("one"),
        F.count_if(F.col("purchase_days") >= 2).alias("two"),
        F.count_if(F.col("purchase_days") >= 3).alias("three"),
    ).select(
        F.col("n").alias("buyer_count"),
        ratio("one", "n", 100).alias("pct_1_purchase_day"),
        ratio("two", "n", 100).alias("pct_2plus_purchase_days"),
        ratio("three", "n", 100).alias("pct_3plus_purchase_days"),
        F.col("two").alias("repeat_capable_customers"),
    )
    return stats.unionByName(as_metrics(shares))


def recent_buyers(buy: DataFrame, p: Params) -> DataFrame:
    """Share of buyers with a purchase in the last N days before the last purchase of all."""
    last = buy.groupBy("client_id").agg(F.max("event_ts").alias("last"))
    since = buy.agg(F.max("event_ts")).scalar() - days(p.recent_buyer_days)
    return (
        last.select((F.col("last") >= since).alias("recent"))
        .agg(F.count(F.lit(1)).alias("n_buyers"), F.count_if("recent").alias("n_recent_buyers"))
        .withColumn("pct_recent_buyers", ratio("n_recent_buyers", "n_buyers", 100))
    )


def gap_seconds(buy: DataFrame) -> DataFrame:
    """``(gap, n)``: how often each gap in whole seconds lies between consecutive occasions.

    Gaps inside a day come from that day's occasions; the gap from one day to the next from
    the last and first occasion of the two days.
    """
    occ = buy.filter(F.col("event_ts").isNotNull()).select("client_id", "event_ts").distinct()
    occ = occ.withColumn("d", day("event_ts"))
    in_day = Window.partitionBy("client_id", "d").orderBy("event_ts")
    inside = occ.select(seconds_between(F.lag("event_ts").over(in_day), "event_ts").alias("gap"))
    by_day = Window.partitionBy("client_id").orderBy("d")
    edges = buy.groupBy("client_id", day("event_ts").alias("d")).agg(
        F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi")
    )
    between = edges.filter(F.col("d").isNotNull()).select(
        seconds_between(F.lag("hi").over(by_day), "lo").alias("gap")
    )
    return (
        inside.unionByName(between)
        .filter(F.col("gap").isNotNull())
        .groupBy("gap")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def purchase_gap_distribution(buy: DataFrame) -> DataFrame:
    """Gaps between occasions in fractional days."""
    counted = materialize(gap_seconds(buy))
    probs = (0.25, 0.5, 0.75, 0.9, 0.95)
    return counted.agg(
        F.sum("n").alias("n_gaps"), (F.sum(F.col("gap") * F.col("n")) / F.sum("n") / 86400.0).alias("gap_mean_days")
    ).select("*", *_quantile_columns(counted, "gap", {f"gap_p{int(100 * x)}_days": x for x in probs}, 86400.0))


def _quantile_columns(counted: DataFrame, value: str, names: dict[str, float], unit: float) -> list[Column]:
    """Quantiles of counted values as scalar columns; no task holds all values."""
    rows = counted_quantiles(counted, value, "n", list(names.values()))
    pick = [F.max(F.when(F.col("prob") == x, F.col("quantile") / unit)).alias(name) for name, x in names.items()]
    one = rows.agg(F.struct(*pick)).scalar()
    return [one[name].alias(name) for name in names]


def cart_counts(streams: Streams) -> DataFrame:
    per_client = events_per_client(streams.events).filter(F.col("event_type").isin("add_to_cart", "remove_from_cart"))
    counted = per_client.groupBy("event_type", "n").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("event_type").agg(
        F.sum("c").alias("n_clients"),
        (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean_per_client"),
        F.percentile("n", 0.5, F.col("c")).alias("median_per_client"),
    )


def top_cart_items(streams: Streams, p: Params) -> DataFrame:
    """Most added and most removed items side by side; equal counts go by sku."""
    counts = (
        streams.events.filter(F.col("event_type").isin("add_to_cart", "remove_from_cart"))
        .groupBy("event_type", "sku")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("event_type").orderBy(F.col("n").desc(), "sku")
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= p.top_items)

    def pick(kind, c):
        return F.max(F.when(F.col("event_type") == kind, F.col(c)))

    return top.groupBy("rank").agg(
        pick("add_to_cart", "sku").alias("added_sku"),
        pick("add_to_cart", "n").alias("n_added"),
        pick("remove_from_cart", "sku").alias("removed_sku"),
        pick("remove_from_cart", "n").alias("n_removed"),
    )


def add_to_buy(streams: Streams) -> DataFrame:
    """Share of added (client, item) pairs bought at or after the first add, and the hours."""
    pairs = cart_pairs(streams).filter((F.col("n_add") > 0) & F.col("sku").isNotNull())
    secs = F.when(F.col("first_buy_ts") >= F.col("first_add_ts"), seconds_between("first_add_ts", "first_buy_ts"))
    counted = materialize(pairs.groupBy(secs.alias("secs")).agg(F.count(F.lit(1)).alias("n")))
    hit = F.col("secs").isNotNull()
    out = counted.agg(
        F.sum("n").alias("total_pairs"),
        F.sum(F.when(hit, F.col("n"))).alias("matched_pairs"),
        (F.sum(F.col("secs") * F.col("n")) / F.sum(F.when(hit, F.col("n")))).alias("mean_secs"),
    )
    return out.select(
        "matched_pairs",
        "total_pairs",
        ratio("matched_pairs", "total_pairs", 100).alias("conversion_pct"),
        (F.col("mean_secs") / 3600.0).alias("mean_hours"),
        *_quantile_columns(counted, "secs", {"median_hours": 0.5, "p90_hours": 0.9}, 3600.0),
    )


def remove_then_buy(streams: Streams) -> DataFrame:
    """Share of removed (client, item) pairs bought at or after the first removal."""
    pairs = cart_pairs(streams).filter((F.col("n_remove") > 0) & F.col("sku").isNotNull())
    return pairs.agg(
        F.count_if(F.col("first_buy_ts") >= F.col("first_remove_ts")).alias("remove_then_buy_pairs"),
        F.count(F.lit(1)).alias("remove_total_pairs"),
    ).withColumn("remove_then_buy_pct", ratio("remove_then_buy_pairs", "remove_total_pairs", 100))


def _browsing_spread(rows: DataFrame) -> DataFrame:
    """Mean and median of visits and searches over the clients that have any."""
    only = rows.select(
        *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("page_visit", "search_query")]
    )
    return spread_of(only, ["page_visit", "search_query"], [0.5]).select(
        F.col("metric").alias("event_type"),
        F.col("n_rows").alias("n_clients"),
        F.col("mean").alias("mean_per_client"),
        F.col("p50").alias("median_per_client"),
    )


def pre_purchase_browsing(streams: Streams) -> DataFrame:
    """Visits and searches of buyers before their first purchase.

    Days before the first purchase count whole. On the day itself events are compared one
    by one, joined per (client, day).
    """
    daily = daily_activity(streams).select("client_id", "activity_date", "n_page_visit", "n_search_query")
    firsts = streams.buy.groupBy("client_id").agg(F.min("event_ts").alias("first_buy"))
    earlier = (
        daily.join(firsts, "client_id")
        .filter(F.col("activity_date") < day("first_buy"))
        .select(
            "client_id",
            F.col("n_page_visit").alias("page_visit"),
            F.col("n_search_query").alias("search_query"),
        )
    )
    browsing = streams.events.filter(F.col("event_type").isin("page_visit", "search_query"))
    same_day = (
        browsing.withColumn("d", day("event_ts"))
        .join(firsts.withColumn("d", day("first_buy")), ["client_id", "d"])
        .filter(F.col("event_ts") < F.col("first_buy"))
        .select(
            "client_id",
            *[(F.col("event_type") == k).cast("bigint").alias(k) for k in ("page_visit", "search_query")],
        )
    )
    return _browsing_spread(
        earlier.unionByName(same_day)
        .groupBy("client_id")
        .agg(F.sum("page_visit").alias("page_visit"), F.sum("search_query").alias("search_query"))
    )


def non_buyer_browsing(streams: Streams) -> DataFrame:
    kind = F.col("event_type")
    per_client = streams.events.groupBy("client_id").agg(
        F.count_if(kind == "page_visit").alias("page_visit"),
        F.count_if(kind == "search_query").alias("search_query"),
        F.count_if(kind == "product_buy").alias("buys"),
    )
    return _browsing_spread(per_client.filter(F.col("buys") == 0))


def same_timestamp_share(buy: DataFrame) -> DataFrame:
    """Consecutive purchase rows of a client with equal time, and the gap per row and occasion.

    Gaps between the first and last purchase add up to their distance, whatever lies between.
    """
    known = buy.filter(F.col("event_ts").isNotNull())
    per_client = known.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("event_ts").alias("n_occ"),
        F.min("event_ts").alias("lo"),
        F.max("event_ts").alias("hi"),
    )
    per_client = per_client.withColumn("span", epoch_second("hi") - epoch_second("lo"))
    sums = per_client.agg(
        F.sum(F.col("n_rows") - 1).alias("consecutive_rows"),
        F.sum(F.col("n_rows") - F.col("n_occ")).alias("same_ts_rows"),
        F.sum(F.col("n_occ") - 1).alias("occasion_gaps"),
        F.sum("span").alias("span"),
    )
    return sums.select(
        "consecutive_rows",
        "same_ts_rows",
        ratio("same_ts_rows", "consecutive_rows", 100).alias("same_ts_pct"),
        ratio(F.col("span") / 86400.0, "consecutive_rows").alias("row_gap_mean_days"),
        ratio(F.col("span") / 86400.0, "occasion_gaps").alias("occasion_gap_mean_days"),
    )
