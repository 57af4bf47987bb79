"""Point-in-time panels: features from before each snapshot, labels from after it.

The log is reduced to one row per client and day. Each such row is then handed to the few
grid dates it matters for, which follow from the date by arithmetic, so no event is
compared with the grid. Counts "so far" enter at the first grid date after the day and are
summed up along the client's grid rows.

An event at midnight of a snapshot date is neither before nor after that snapshot. Labels
reach up to and including midnight of their last day, which is why purchase occasions at
exactly midnight are counted apart.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import day, days_between, index_range
from ..params import Params
from ..plans.grid import Grid, snapshot_grid
from ..plans.joins import spread_lookup
from ..sources.streams import Streams


def category_starts(streams: Streams) -> DataFrame:
    """First and second purchase occasion of each client in each category."""
    if streams.category_start_table is not None:
        return streams.category_start_table
    buys = streams.buy.filter(F.col("event_ts").isNotNull())
    per_sku = buys.select("client_id", "sku", "event_ts").distinct()
    known = spread_lookup(per_sku, streams.products.select("sku", "category"), ["sku"], ["client_id", "event_ts"])
    w = Window.partitionBy("client_id", "category").orderBy("event_ts")
    return (
        known.select("client_id", "category", "event_ts")
        .distinct()
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= 2)
        .groupBy("client_id", "category")
        .agg(
            F.min("event_ts").alias("first_ts"),
            F.max(F.when(F.col("rank") == 2, F.col("event_ts"))).alias("second_ts"),
        )
    )


def category_rates(starts: DataFrame, grid: Grid, p: Params) -> DataFrame:
    """Per grid index and category: customers so far, of those with a second occasion, rate.

    Each (client, category) adds one to the index of its first and of its second
    occasion; a running sum per category over at most the grid's length gives the rest.
    """
    def step(ts, customers, repeaters):
        idx = grid.first_after(day(ts))
        parts = F.struct(idx.alias("idx"), F.lit(customers).alias("customers"), F.lit(repeaters).alias("repeaters"))
        return F.when(F.col(ts).isNotNull() & (idx <= grid.last), parts)

    steps = (
        grid.attach(starts)
        .select("category", F.explode(F.array(step("first_ts", 1, 0), step("second_ts", 0, 1))).alias("s"))
        .filter(F.col("s").isNotNull())
        .groupBy("category", F.col("s.idx").alias("idx"))
        .agg(F.sum("s.customers").alias("customers"), F.sum("s.repeaters").alias("repeaters"))
    )
    along = Window.partitionBy("category").orderBy("idx")
    runs = grid.attach(steps).select(
        "category",
        "_grid",
        "idx",
        F.coalesce(F.lead("idx").over(along) - 1, grid.last).alias("until"),
        F.sum("customers").over(along).alias("n_customers"),
        F.sum("repeaters").over(along).alias("n_repurchase_customers"),
    ).filter(F.col("n_customers") >= p.category_min_customers)
    return runs.select(
        "category",
        "_grid",
        "n_customers",
        "n_repurchase_customers",
        (F.col("n_repurchase_customers") / F.col("n_customers")).alias("repurchase_rate"),
        F.explode(index_range(F.col("idx"), F.col("until"))).alias("idx"),
    )


def category_repurchase_by_snapshot(streams: Streams, p: Params) -> DataFrame:
    grid = snapshot_grid(streams.bounds, p)
    return category_rates(category_starts(streams), grid, p).select(
        grid.date(F.col("idx")).alias("snapshot_date"),
        "category",
        "n_customers",
        "n_repurchase_customers",
        "repurchase_rate",
    )


def client_category_rates(starts: DataFrame, grid: Grid, p: Params) -> DataFrame:
    """Per client and grid index: mean rate of the categories bought so far.

    A category below the minimum sample has no rate and is left out of the mean; a client
    with none but such categories gets NULL. The rates of a category travel as one row, an
    array over the grid, and a client's categories are expanded only after that lookup.
    """
    rates = (
        category_rates(starts, grid, p)
        .groupBy("category")
        .agg(F.map_from_entries(F.collect_list(F.struct("idx", "repurchase_rate"))).alias("rates"))
    )
    bought = grid.attach(starts).select(
        "client_id", "category", "_grid", grid.first_after(day("first_ts")).alias("from_idx")
    )
    return (
        spread_lookup(bought, rates, ["category"], ["client_id"], how="left")
        .select("client_id", "rates", F.explode(index_range(F.col("from_idx"), grid.last)).alias("idx"))
        .groupBy("client_id", "idx")
        .agg(F.avg(F.try_element_at("rates", F.col("idx"))).alias("avg_category_repurchase_rate"))
    )


def category_repurchase_avg_by_snapshot(streams: Streams, p: Params, since: date | None = None) -> DataFrame:
    grid = snapshot_grid(streams.bounds, p, since)
    return grid.attach(client_category_rates(category_starts(streams), grid, p)).select(
        grid.date(F.col("idx")).alias("snapshot_date"), "client_id", "avg_category_repurchase_rate"
    )


def _touched(grid: Grid, p: Params) -> Column:
    """Grid indexes a client-day matters for; all later ones for the client's first day."""
    d, ahead = F.col("d"), max(p.activity_days, *p.purchase_windows)
    entry = grid.first_after(d)
    # only purchases matter to earlier snapshots, through their labels
    begin = F.when(F.col("n_occasions") > 0, grid.at_or_after(F.date_sub(d, max(p.label_days)))).otherwise(entry)
    end = F.when(F.col("is_first_day"), grid.last).otherwise(
        F.least(grid.last, F.greatest(entry, grid.at_or_before(F.date_add(d, ahead))))
    )
    return index_range(begin, end)


def panel(streams: Streams, p: Params, keep: Column, since: date | None = None) -> DataFrame:
    """One row per client and snapshot date after the client's first event, all features.

    ``keep`` decides on the totals of a client over the whole log (``all_visits``,
    ``all_adds``, ``all_occasions``, ``first_visit``, ``first_search``) which clients can
    enter at any date; the others are dropped before their days are spread over the grid.
    With ``since``, rows of earlier dates are not made.

    Whatever is added to a client's days comes as one row per client, so that all steps keep
    a hub that is stored by client where it is.
    """
    grid = snapshot_grid(streams.bounds, p, since)
    starts = category_starts(streams)
    new_categories = starts.groupBy("client_id", day("first_ts").alias("d")).agg(F.count("category").alias("n"))
    new_categories = new_categories.groupBy("client_id").agg(
        F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("_new")
    )
    known = streams.days.filter(F.col("d").isNotNull())
    # a category starts on a day with a purchase, which the hub has
    per_day = known.join(new_categories, "client_id", "left")
    per_day = per_day.withColumn("new_categories", F.try_element_at("_new", F.col("d"))).drop("_new")
    by_client = Window.partitionBy("client_id")
    active = F.when(F.col("n_occasions").isNotNull(), F.col("d"))
    totals = {
        "all_visits": F.sum("n_page_visit"),
        "all_adds": F.sum("n_add_to_cart"),
        "all_occasions": F.sum("n_occasions"),
        "first_visit": F.min("first_visit_ts"),
        "first_search": F.min("first_search_ts"),
        "first_day": F.min(active),
    }
    per_day = per_day.select("*", *[x.over(by_client).alias(name) for name, x in totals.items()]).filter(keep)
    is_first_day = F.coalesce(active == F.col("first_day"), F.lit(False))
    at = grid.attach(per_day).withColumn("is_first_day", is_first_day)
    at = at.withColumn("idx", F.explode(_touched(grid, p))).withColumn("s", grid.date(F.col("idx")))

    d, s, idx = F.col("d"), F.col("s"), F.col("idx")
    enters = grid.first_after(d) == idx

    def so_far(x):
        return F.sum(F.when(enters, x))

    def before(x, n):
        return F.sum(F.when((d < s) & (d >= F.date_sub(s, n)), x))

    def bought_within(n):
        ordinary = (F.col("n_occasions") > F.col("has_midnight_buy").cast("int")) & (d >= s) & (d < F.date_add(s, n))
        on_midnight = F.col("has_midnight_buy") & (d > s) & (d <= F.date_add(s, n))
        return F.max(F.coalesce((ordinary | on_midnight).cast("int"), F.lit(0)))

    a = p.activity_days
    flows = at.groupBy("client_id", "idx").agg(
        so_far(F.col("n_page_visit")).alias("visits"),
        so_far(F.col("n_add_to_cart")).alias("adds"),
        so_far(F.col("n_occasions")).alias("occasions"),
        so_far((F.col("n_occasions") > 0).cast("bigint")).alias("purchase_days"),
        so_far(F.col("new_categories")).alias("new_categories"),
        F.max(F.when(enters, F.col("last_buy_ts"))).alias("last_buy_ts"),
        F.min(F.when(enters & (F.col("n_occasions") > 0), d)).alias("first_buy_day"),
        F.min(F.when(enters, F.col("first_visit_ts"))).alias("first_visit_ts"),
        F.min(F.when(enters, F.col("first_search_ts"))).alias("first_search_ts"),
        F.max(enters & F.col("n_occasions").isNotNull()).alias("active"),
        *[before(F.col("n_occasions"), n).alias(f"n_purchases_{n}d") for n in p.purchase_windows],
        before(F.col("n_page_visit"), a).alias(f"n_page_visit_{a}d"),
        before(F.col("n_search_query"), a).alias(f"n_search_query_{a}d"),
        before(F.col("n_add_to_cart"), a).alias(f"n_add_to_cart_{a}d"),
        before(F.col("n_remove_from_cart"), a).alias(f"n_remove_from_cart_{a}d"),
        *[bought_within(n).alias(f"label_purchase_{n}d") for n in p.label_days],
    )
    along = by_client.orderBy("idx")

    def running(fn, c):
        return fn(c).over(along)

    def total(c):
        return F.coalesce(running(F.sum, c), F.lit(0))

    first_buy_day, last_buy = running(F.min, "first_buy_day"), running(F.max, "last_buy_ts")
    n_occ = total("occasions")
    span = F.datediff(day(last_buy), first_buy_day)
    windows = [f"n_purchases_{n}d" for n in p.purchase_windows] + [
        f"n_{k}_{a}d" for k in ("page_visit", "search_query", "add_to_cart", "remove_from_cart")
    ]
    return grid.attach(flows).select(
        grid.date(idx).alias("snapshot_date"),
        "client_id",
        running(F.max, "active").alias("is_active"),
        last_buy.alias("last_purchase_ts"),
        days_between(last_buy, grid.date(idx)).alias("days_since_last_purchase"),
        n_occ.alias("n_purchase_occasions_so_far"),
        total("purchase_days").alias("n_purchase_days_so_far"),
        F.when(n_occ > 1, span / (n_occ - 1)).alias("avg_purchase_gap_days_so_far"),
        total("new_categories").alias("n_categories_so_far"),
        total("visits").alias("cum_visits"),
        total("adds").alias("cum_adds"),
        running(F.min, "first_visit_ts").alias("first_visit_ts"),
        running(F.min, "first_search_ts").alias("first_search_ts"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in windows],
        *[f"label_purchase_{n}d" for n in p.label_days],
    )


def population(streams: Streams, p: Params, since: date | None = None) -> DataFrame:
    """Panel rows of active clients: past buyers, and those browsing with some intent.

    A client is in once it has enough visits, has searched before its first visit, has put
    something in a cart, or has bought. Both panels below are parts of it.
    """
    search_first = F.col("first_search_ts") < F.col("first_visit_ts")
    has_history = F.col("n_purchase_occasions_so_far") > 0
    browsing = F.col("is_active") & (
        (F.col("cum_visits") >= p.high_intent_visits)
        | F.coalesce(search_first, F.lit(False))
        | (F.col("cum_adds") > 0)
    )
    candidate = (
        (F.col("all_occasions") > 0)
        | (F.col("all_visits") >= p.high_intent_visits)
        | F.coalesce(F.col("first_search") < F.col("first_visit"), F.lit(False))
        | (F.col("all_adds") > 0)
    )
    return panel(streams, p, candidate, since).filter(has_history | browsing)


KEY = ["snapshot_date", "client_id"]


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Panel rows with the rate of their client and date; a client's rates come as one row."""
    entry = F.struct("snapshot_date", "avg_category_repurchase_rate")
    each = rates.groupBy("client_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_rates"))
    rate = F.try_element_at("_rates", F.col("snapshot_date"))
    return rows.join(each, "client_id", "left").withColumn("avg_category_repurchase_rate", rate).drop("_rates")


def customer_snapshot(
    streams: Streams, p: Params, rows: DataFrame | None = None, rates: DataFrame | None = None, since: date | None = None
) -> DataFrame:
    """Past buyers at each snapshot date with features and repurchase labels.

    ``rows`` (the population) and ``rates`` (the category rates per client) may be given as
    written tables.
    """
    rows = panel(streams, p, F.col("all_occasions") > 0, since) if rows is None else rows
    rates = category_repurchase_avg_by_snapshot(streams, p, since) if rates is None else rates
    a = p.activity_days
    return _with_rates(rows.filter(F.col("n_purchase_occasions_so_far") > 0), rates).select(
        *KEY,
        "last_purchase_ts",
        "days_since_last_purchase",
        "n_purchase_occasions_so_far",
        "n_purchase_days_so_far",
        "avg_purchase_gap_days_so_far",
        *[f"n_purchases_{n}d" for n in p.purchase_windows],
        "n_categories_so_far",
        "avg_category_repurchase_rate",
        *[f"n_{k}_{a}d" for k in ("page_visit", "search_query", "add_to_cart", "remove_from_cart")],
        *[f"label_purchase_{n}d" for n in p.label_days],
        *[(F.col(f"label_purchase_{n}d") == 0).alias(f"label_inactive_{n}d") for n in p.label_days],
    )


def churn_target(snapshot: DataFrame, p: Params) -> DataFrame:
    """The snapshot panel with inactivity as the label."""
    purchase = [f"label_purchase_{n}d" for n in p.label_days]
    names = {f"label_inactive_{n}d": f"churn_{n}d" for n in p.label_days}
    return snapshot.drop(*purchase).withColumnsRenamed(names)


def purchase_propensity(
    streams: Streams, p: Params, rows: DataFrame | None = None, rates: DataFrame | None = None, since: date | None = None
) -> DataFrame:
    """The active population at each snapshot date, with or without a purchase so far."""
    rows = population(streams, p, since) if rows is None else rows
    rates = category_repurchase_avg_by_snapshot(streams, p, since) if rates is None else rates
    a = p.activity_days
    return _with_rates(rows, rates).select(
        *KEY,
        (F.col("n_purchase_occasions_so_far") > 0).alias("has_purchase_history"),
        "last_purchase_ts",
        "days_since_last_purchase",
        "n_purchase_occasions_so_far",
        *[f"n_{k}_{a}d" for k in ("page_visit", "search_query", "add_to_cart", "remove_from_cart")],
        "avg_category_repurchase_rate",
        *[F.col(f"label_purchase_{n}d").alias(f"will_purchase_{n}d") for n in p.label_days],
    )
