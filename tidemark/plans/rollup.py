"""One row per client and day: the hub most customer tables are built from.

It is small next to the log, has at most one row per client and day whatever the client
does, and holds what is needed to rebuild counts, spans, purchase gaps and panels. Unused
columns are pruned, so a query that only counts events pays for nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import day, midnight

EVENT_TYPES = ("page_visit", "search_query", "add_to_cart", "remove_from_cart", "product_buy")


def activity_days(events: DataFrame) -> DataFrame:
    """Counts and first and last times per client and day."""
    return _per_day(events)


def client_days(events: DataFrame, buy: DataFrame) -> DataFrame:
    """The same with the day's purchase occasions.

    The few purchases are made distinct on their own and enter as extra rows, so the log is
    shuffled once, after partial aggregation, and is not joined.
    """
    occasions = buy.select("client_id", "event_ts").filter(F.col("event_ts").isNotNull()).distinct()
    rows = events.select("client_id", "event_ts", "event_type").unionByName(
        occasions.withColumn("event_type", F.lit("occasion"))
    )
    is_occasion = F.col("event_type") == "occasion"
    at_midnight = F.col("event_ts") == midnight(day("event_ts"))
    return _per_day(
        rows,
        F.count_if(is_occasion).alias("n_occasions"),
        (F.count_if(is_occasion & at_midnight) > 0).alias("has_midnight_buy"),
    )


def _per_day(rows: DataFrame, *more) -> DataFrame:
    ts, kind = F.col("event_ts"), F.col("event_type")

    def of(name):
        return F.when(kind == name, ts)

    counts = {t: F.count_if(kind == t) for t in EVENT_TYPES}
    return rows.groupBy("client_id", day("event_ts").alias("d")).agg(
        *[c.alias(f"n_{t}") for t, c in counts.items()],
        sum(counts.values()).alias("n_events"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.min(of("product_buy")).alias("first_buy_ts"),
        F.max(of("product_buy")).alias("last_buy_ts"),
        F.min(of("page_visit")).alias("first_visit_ts"),
        F.min(of("search_query")).alias("first_search_ts"),
        *more,
    )
