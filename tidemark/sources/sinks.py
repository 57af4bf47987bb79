"""Layered build of all tables, the table catalogue, and CSV export of small results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, marts, panel, staging
from ..params import Params
from ..plans.rollup import EVENT_TYPES
from .streams import Streams

Make = Callable[[Streams, Params, dict[str, DataFrame]], DataFrame]

STAGING: dict[str, Make] = {
    **{f"stg_{k}": (lambda s, p, t, k=k: staging.staged(s, k, p)) for k in EVENT_TYPES},
    "stg_products": lambda s, p, t: s.products,
}
FACTS: dict[str, Make] = {
    "int_client_day": lambda s, p, t: s.days,
    "int_client_rollup": lambda s, p, t: marts.client_rollup(s),
    "int_observation_period": lambda s, p, t: facts.observation_period(s, p),
    "int_purchase_gap": lambda s, p, t: facts.purchase_gap(s.buy),
    "int_purchase_history": lambda s, p, t: facts.purchase_history(s.buy),
    "int_cart_pair": lambda s, p, t: facts.cart_pairs(s),
    "int_cart_behavior": lambda s, p, t: facts.cart_behavior(s),
    "int_daily_activity": lambda s, p, t: facts.daily_activity(s),
    "int_category_behavior": lambda s, p, t: facts.category_behavior(s.buy, s.products),
    "int_category_start": lambda s, p, t: panel.category_starts(s),
    "int_category_repurchase": lambda s, p, t: panel.category_repurchase_by_snapshot(s, p),
    "int_category_repurchase_avg": lambda s, p, t: panel.category_repurchase_avg_by_snapshot(s, p),
    "int_population": lambda s, p, t: panel.population(s, p),
}
MARTS: dict[str, Make] = {
    "mart_customer_360": lambda s, p, t: marts.customer_360(s, p),
    "mart_customer_daily": lambda s, p, t: t["int_daily_activity"],
    "mart_customer_weekly": lambda s, p, t: marts.customer_weekly(t["int_daily_activity"]),
    "mart_customer_cohort": lambda s, p, t: marts.customer_cohort(t["int_purchase_gap"]),
    "mart_customer_retention": lambda s, p, t: marts.customer_retention(s, p),
    "mart_customer_lifecycle": lambda s, p, t: marts.customer_lifecycle(s, p),
    "mart_customer_segment": lambda s, p, t: marts.customer_segment(s, p, t["int_cart_behavior"]),
    "mart_customer_snapshot": lambda s, p, t: panel.customer_snapshot(s, p, t["int_population"], t["int_category_repurchase_avg"]),
    "mart_churn_target": lambda s, p, t: panel.churn_target(t["mart_customer_snapshot"], p),
    "mart_purchase_propensity": lambda s, p, t: panel.purchase_propensity(
        s, p, t["int_population"], t["int_category_repurchase_avg"]
    ),
}
BY_DATE = {"int_population", "mart_customer_snapshot", "mart_churn_target", "mart_purchase_propensity"}
# written tables that later steps read instead of working them out again
REUSED = {
    "int_client_day": "day_table",
    "int_client_rollup": "rollup_table",
    "int_cart_pair": "cart_pair_table",
    "int_category_start": "category_start_table",
}


def write_table(df: DataFrame, folder: str, name: str, files_per_date: int = 4) -> DataFrame:
    """Write a table as Parquet, panels by snapshot date, and read it back.

    A panel's dates are cut in ``files_per_date`` parts before writing, so that a date has
    so many files and not one from every task.
    """
    path = f"{folder}/{name}"
    if name in BY_DATE:
        part = F.pmod(F.xxhash64("client_id"), F.lit(files_per_date))
        df.repartition("snapshot_date", part).write.mode("overwrite").partitionBy("snapshot_date").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def build_layers(streams: Streams, p: Params, folder: str) -> dict[str, DataFrame]:
    """Write staging, facts and marts in order; each table reads the written ones before it.

    The log itself is read by staging and by the client-day rollup. Customer tables and
    panels then work on the rollup and on the purchase and cart streams.
    """
    built: dict[str, DataFrame] = {}
    for name, make in STAGING.items():
        built[name] = write_table(make(streams, p, built), folder, name)
    clean = {kind: built[f"stg_{kind}"].drop("is_burst_repeat") for kind in EVENT_TYPES}
    streams = Streams(
        buy=clean["product_buy"],
        add=clean["add_to_cart"],
        remove=clean["remove_from_cart"],
        visit=clean["page_visit"],
        search=clean["search_query"],
        products=built["stg_products"],
    )
    for name, make in {**FACTS, **MARTS}.items():
        built[name] = write_table(make(streams, p, built), folder, name)
        if name in REUSED:
            streams = replace(streams, **{REUSED[name]: built[name]})
    return built


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table as one frame."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def catalogue(spark: SparkSession, prefixes: tuple[str, ...] = ("stg_", "int_", "mart_")) -> DataFrame:
    """Row counts of the session's tables and views whose name starts with a layer prefix."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefixes))
    if not names:
        return spark.createDataFrame([], "table_name string, n_rows bigint")
    return row_counts({n: spark.table(n) for n in names})


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; meant for aggregates of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
