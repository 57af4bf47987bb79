"""Per-customer facts.

A purchase occasion is one distinct ``(client_id, event_ts)``. Wherever an order within a
client is needed, rows are first reduced or cut by calendar day, so that the ordered group
has at most one row per day of the log however many events the client has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import count_where, day, days, days_between, seconds_between
from ..params import Params
from ..plans.joins import spread_lookup
from ..plans.rollup import EVENT_TYPES
from ..sources.streams import Streams


def log_start(streams: Streams) -> Column:
    return streams.bounds.select("lo").scalar()


def log_end(streams: Streams) -> Column:
    return streams.bounds.select("hi").scalar()


def observation_period(streams: Streams, p: Params) -> DataFrame:
    """First and last event, days between, active days; flags for a span cut off by the log."""
    span = streams.rollup_table
    if span is None:
        span = streams.activity.groupBy("client_id").agg(
            F.min("first_ts").alias("first_event_ts"),
            F.max("last_ts").alias("last_event_ts"),
            F.count("d").alias("n_active_days"),
        )
    first = F.col("first_event_ts")
    return span.select(
        "client_id",
        "first_event_ts",
        "last_event_ts",
        days_between("first_event_ts", "last_event_ts").alias("observation_days"),
        "n_active_days",
        (first < log_start(streams) + days(p.left_censor_days)).alias("is_left_censor_candidate"),
        (first >= log_end(streams) - days(p.right_censor_days)).alias("is_right_censor_candidate"),
    )


def occasions(buy: DataFrame) -> DataFrame:
    return buy.filter(F.col("event_ts").isNotNull()).select("client_id", "event_ts").distinct()


def occasion_days(buy: DataFrame) -> DataFrame:
    """Rows and occasions per client and day, with the gap in days to the client's previous day.

    Rows without a time form one group without a day and without occasions.
    """
    per_day = buy.groupBy("client_id", day("event_ts").alias("d")).agg(
        F.count_distinct("event_ts").alias("n_occasions"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )
    w = Window.partitionBy("client_id").orderBy(F.col("d").asc_nulls_first())
    return per_day.withColumn("day_gap", F.datediff("d", F.lag("d").over(w)).cast("bigint"))


def gap_counts(buy: DataFrame) -> DataFrame:
    """How often each gap in days occurs between consecutive occasions, over all clients.

    Occasions on one day are 0 days apart; only the first of a day looks back to another day.
    """
    same_day = F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("n_occasions") - 1).alias("n"))
    other_day = F.struct(F.col("day_gap").alias("gap"), F.lit(1).cast("bigint").alias("n"))
    return (
        occasion_days(buy)
        .select(F.explode(F.array(same_day, other_day)).alias("g"))
        .filter(F.col("g.gap").isNotNull() & (F.col("g.n") > 0))
        .groupBy(F.col("g.gap").alias("gap"))
        .agg(F.sum("g.n").alias("n"))
    )


def purchase_gap(buy: DataFrame) -> DataFrame:
    """Purchase counts and statistics of the day gaps between occasions, per buyer.

    Gaps inside a day are 0, so they only add to the count; sums of whole numbers keep
    mean and deviation exact.
    """
    g = F.col("day_gap")
    per_client = (
        occasion_days(buy)
        .groupBy("client_id")
        .agg(
            F.sum("n_rows").alias("n_purchases"),
            F.count("d").alias("n_purchase_days"),
            F.min("first_ts").alias("first_purchase_ts"),
            F.max("last_ts").alias("last_purchase_ts"),
            (F.sum("n_occasions") - 1).alias("n"),
            F.max(F.when(F.col("n_occasions") > 1, F.lit(0).cast("bigint"))).alias("zero"),
            F.sum(g).alias("s"),
            F.sum(g * g).alias("ss"),
            F.min(g).alias("lo"),
            F.max(g).alias("hi"),
        )
    )
    n, s = F.col("n").cast("double"), F.coalesce("s", F.lit(0)).cast("double")
    ss = F.coalesce("ss", F.lit(0)).cast("double")
    return per_client.select(
        "client_id",
        "n_purchases",
        "n_purchase_days",
        "first_purchase_ts",
        "last_purchase_ts",
        F.when(n >= 1, s / n).alias("avg_purchase_gap_days"),
        F.when(n >= 2, F.sqrt((n * ss - s * s) / (n * (n - 1)))).alias("stddev_purchase_gap_days"),
        F.least("zero", "lo").alias("min_purchase_gap_days"),
        F.greatest("zero", "hi").alias("max_purchase_gap_days"),
    )


def purchase_history(buy: DataFrame) -> DataFrame:
    """Each purchase row with its place among the client's rows and occasions.

    Places are counted inside a day and shifted by the totals of the client's earlier days.
    """
    known = buy.filter(F.col("event_ts").isNotNull()).withColumn("d", day("event_ts"))
    earlier = Window.partitionBy("client_id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    shift = occasion_days(known).select(
        "client_id",
        "d",
        "day_gap",
        F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("n_occasions").over(earlier), F.lit(0)).alias("occasions_before"),
    )
    in_day = Window.partitionBy("client_id", "d")
    rows = known.select(
        *known.columns,
        F.row_number().over(in_day.orderBy("event_ts", "sku")).alias("row_in_day"),
        F.dense_rank().over(in_day.orderBy("event_ts")).alias("occasion_in_day"),
    ).join(shift, ["client_id", "d"])
    seq = F.col("occasions_before") + F.col("occasion_in_day")
    return rows.select(
        *buy.columns,
        (F.col("rows_before") + F.col("row_in_day")).alias("raw_row_seq"),
        seq.alias("purchase_occasion_seq"),
        F.when(F.col("occasion_in_day") > 1, F.lit(0).cast("bigint"))
        .otherwise(F.col("day_gap"))
        .alias("days_since_prev_purchase_occasion"),
        (seq == 1).alias("is_first_observed_purchase"),
    )


def edge_occasions(buy: DataFrame, last: bool = False) -> DataFrame:
    """The first two (or last two) occasions of each buyer: ``ts_1`` the outermost, ``ts_2``.

    The rank filter is applied before the shuffle too, so a task sends at most two rows
    per client.
    """
    order = F.col("event_ts").desc() if last else F.col("event_ts").asc()
    rank = F.row_number().over(Window.partitionBy("client_id").orderBy(order))
    return (
        occasions(buy)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= 2)
        .groupBy("client_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("event_ts"))).alias("ts_1"),
            F.max(F.when(F.col("rank") == 2, F.col("event_ts"))).alias("ts_2"),
        )
    )


def cart_pairs(streams: Streams) -> DataFrame:
    """Per (client, sku): counts, first add and buy, and the first removal not before that add.

    Everything but the last is one aggregate that is reduced before the shuffle. Only
    removals, one per instant, are then compared with their pair's first add.
    """
    if streams.cart_pair_table is not None:
        return streams.cart_pair_table
    rows = streams.events.filter(F.col("event_type").isin("add_to_cart", "remove_from_cart", "product_buy"))
    ts = F.col("event_ts")
    add, remove, buy = (F.col("event_type") == t for t in ("add_to_cart", "remove_from_cart", "product_buy"))
    pairs = rows.groupBy("client_id", "sku").agg(
        F.count_if(add).alias("n_add"),
        F.min(F.when(add, ts)).alias("first_add_ts"),
        F.max(F.when(add, ts)).alias("last_add_ts"),
        F.count_if(remove).alias("n_remove"),
        F.min(F.when(remove, ts)).alias("first_remove_ts"),
        F.max(F.when(remove, ts)).alias("last_remove_ts"),
        F.min(F.when(buy, ts)).alias("first_buy_ts"),
    )
    removals = rows.filter(remove & ts.isNotNull()).select(
        F.col("client_id").alias("_client"), F.col("sku").alias("_sku"), "event_ts"
    )
    # a removal may lack its client or item, and so may its pair
    same = F.col("client_id").eqNullSafe(F.col("_client")) & F.col("sku").eqNullSafe(F.col("_sku"))
    added = pairs.filter("first_add_ts IS NOT NULL AND last_remove_ts >= first_add_ts").select("client_id", "sku", "first_add_ts")
    after = (
        removals.distinct()
        .join(added, same & (ts >= F.col("first_add_ts")))
        .groupBy("_client", "_sku")
        .agg(F.min("event_ts").alias("remove_after_add_ts"))
    )
    return pairs.join(after, same, "left").drop("_client", "_sku")


def _removal_median() -> Column:
    """Median seconds from a pair's first add to the removal after it.

    It keeps one counter per distinct gap of a client, of which there are at most as many as
    the client has items.
    """
    gap = seconds_between("first_add_ts", "remove_after_add_ts")
    return F.percentile(F.when(F.col("sku").isNotNull(), gap), 0.5).alias("median_seconds_add_to_remove")


def removal_gap(streams: Streams) -> DataFrame:
    """``median_seconds_add_to_remove`` of the clients with a removal after an add."""
    with_removal = cart_pairs(streams).filter(F.col("sku").isNotNull() & F.col("remove_after_add_ts").isNotNull())
    return with_removal.groupBy("client_id").agg(_removal_median())


def cart_behavior(streams: Streams) -> DataFrame:
    """Cart use per client with an add or a removal."""
    pair = F.col("sku").isNotNull()
    converted = pair & (F.col("first_buy_ts") >= F.col("first_add_ts"))
    hours = seconds_between("first_add_ts", "first_buy_ts") / F.lit(3600.0)
    return (
        cart_pairs(streams)
        .groupBy("client_id")
        .agg(
            F.sum("n_add").alias("n_add"),
            count_where(pair & (F.col("n_add") > 0)).alias("n_add_distinct_sku"),
            F.min("first_add_ts").alias("first_add_ts"),
            F.max("last_add_ts").alias("last_add_ts"),
            F.sum("n_remove").alias("n_remove"),
            count_where(pair & (F.col("n_remove") > 0)).alias("n_remove_distinct_sku"),
            F.min("first_remove_ts").alias("first_remove_ts"),
            F.max("last_remove_ts").alias("last_remove_ts"),
            count_where(converted).alias("n_add_to_buy_pairs"),
            F.avg(F.when(converted, hours)).alias("avg_hours_add_to_buy"),
            _removal_median(),
        )
        .filter((F.col("n_add") > 0) | (F.col("n_remove") > 0))
    )


def add_to_buy_hours(streams: Streams) -> DataFrame:
    """Per client: pairs bought at or after their first add, and the mean hours between.

    Only the first purchase of a pair is looked at; one before the add drops the pair.
    """
    hours = seconds_between("first_add_ts", "first_buy_ts") / F.lit(3600.0)
    return (
        cart_pairs(streams)
        .filter(F.col("sku").isNotNull() & (F.col("first_buy_ts") >= F.col("first_add_ts")))
        .groupBy("client_id")
        .agg(F.count(F.lit(1)).alias("n_add_to_buy_pairs"), F.avg(hours).alias("avg_hours_add_to_buy"))
    )


def cart_clients(streams: Streams) -> DataFrame:
    """Clients with an add or a removal."""
    carts = streams.events.filter(F.col("event_type").isin("add_to_cart", "remove_from_cart"))
    return carts.select("client_id").distinct()


def daily_activity(streams: Streams) -> DataFrame:
    """Events per client and day, by type and in all, and how many types occurred."""
    counts = [f"n_{t}" for t in EVENT_TYPES]
    kinds = sum((F.col(c) > 0).cast("bigint") for c in counts)
    return streams.activity.select(
        "client_id",
        F.col("d").alias("activity_date"),
        *counts,
        F.col("n_events").alias("n_events_total"),
        kinds.alias("n_event_types_active"),
    )


def category_behavior(buy: DataFrame, products: DataFrame) -> DataFrame:
    """Purchases per client and category; a sku without product is left out.

    Purchases are reduced to (client, sku) before the product lookup.
    """
    per_sku = buy.groupBy("client_id", "sku").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi")
    )
    return (
        spread_lookup(per_sku, products.select("sku", "category"), ["sku"], ["client_id"])
        .groupBy("client_id", "category")
        .agg(
            F.sum("n").alias("n_purchases"),
            F.count(F.lit(1)).alias("n_distinct_sku"),
            F.min("lo").alias("first_purchase_ts"),
            F.max("hi").alias("last_purchase_ts"),
        )
    )
