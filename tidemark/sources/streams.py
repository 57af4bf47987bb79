"""The five event streams and the product table, from Parquet files or the test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rollup import activity_days, client_days

ITEM_KEY = {
    "product_buy": "sku",
    "add_to_cart": "sku",
    "remove_from_cart": "sku",
    "page_visit": "url",
    "search_query": "query",
}


@dataclass(frozen=True)
class Streams:
    """Typed event frames ``(client_id, event_ts, <item key>)`` and the product dimension.

    ``tagged`` may hold all events as one frame when they come from one table; otherwise
    it is the union of the five. The last four may hold tables written before: the
    client-day rollup, the client rollup, cart facts per (client, sku), and the first
    occasions per (client, category). Where one is not given it is worked out from the
    events.
    """

    buy: DataFrame
    add: DataFrame
    remove: DataFrame
    visit: DataFrame
    search: DataFrame
    products: DataFrame
    tagged: DataFrame | None = None
    day_table: DataFrame | None = None
    rollup_table: DataFrame | None = None
    cart_pair_table: DataFrame | None = None
    category_start_table: DataFrame | None = None

    def by_type(self) -> dict[str, DataFrame]:
        return {
            "page_visit": self.visit,
            "search_query": self.search,
            "add_to_cart": self.add,
            "remove_from_cart": self.remove,
            "product_buy": self.buy,
        }

    @property
    def events(self) -> DataFrame:
        """All events with their type; ``sku`` is NULL for visits and searches."""
        if self.tagged is not None:
            return self.tagged
        out = None
        for name, df in self.by_type().items():
            sku = F.col("sku") if "sku" in df.columns else F.lit(None).cast("bigint")
            part = df.select("client_id", "event_ts", F.lit(name).alias("event_type"), sku.alias("sku"))
            out = part if out is None else out.unionByName(part)
        return out

    @property
    def days(self) -> DataFrame:
        """One row per client and day, with purchase occasions."""
        return self.day_table if self.day_table is not None else client_days(self.events, self.buy)

    @property
    def activity(self) -> DataFrame:
        """One row per client and day, counts and times only."""
        return self.day_table if self.day_table is not None else activity_days(self.events)

    @property
    def bounds(self) -> DataFrame:
        """First and last event time of the log as one row ``(lo, hi)``."""
        if self.day_table is not None:
            return self.day_table.agg(F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi"))
        return self.events.agg(F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi"))


def typed_events(raw: DataFrame, key: str, client: str = "client_id", ts: str = "timestamp") -> DataFrame:
    """Text time to timestamp; an unreadable time becomes NULL and the row is kept."""
    return raw.select(
        F.col(client).alias("client_id"), F.col(ts).try_cast("timestamp_ntz").alias("event_ts"), F.col(key)
    )


def product_dimension(raw: DataFrame) -> DataFrame:
    return raw.select(
        "sku", "category", F.col("price").alias("price_bucket"), F.col("name").alias("name_embedding")
    )


def read_streams(spark: SparkSession, folder: str) -> Streams:
    """Read ``<event type>.parquet`` and ``product_properties.parquet`` from a folder."""

    def load(name):
        return typed_events(spark.read.parquet(f"{folder}/{name}.parquet"), ITEM_KEY[name])

    return Streams(
        buy=load("product_buy"),
        add=load("add_to_cart"),
        remove=load("remove_from_cart"),
        visit=load("page_visit"),
        search=load("search_query"),
        products=product_dimension(spark.read.parquet(f"{folder}/product_properties.parquet")),
    )


# event name in the test table -> stream
TEST_EVENT_NAMES = {
    "view": "page_visit",
    "click": "search_query",
    "signup": "add_to_cart",
    "error": "remove_from_cart",
    "purchase": "product_buy",
}


def from_event_table(spark: SparkSession, sf_dir: str) -> Streams:
    """All rows of the test ``events`` table as the five streams.

    A client is one of 20 devices of a user, told apart by the ``k`` property; the item is
    the tens of ``value``. Products are the ``part`` table.
    """
    name = F.create_map(*[F.lit(x) for kv in TEST_EVENT_NAMES.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") * 20 + F.floor(k / 5)).alias("client_id"),
        F.col("ts").alias("event_ts"),
        F.col("event_type").alias("raw_type"),
        name[F.col("event_type")].alias("event_type"),
        F.floor(F.col("value") / 10).alias("item"),
        k.alias("k"),
    )
    sku = F.when(F.col("event_type").isin("add_to_cart", "remove_from_cart", "product_buy"), F.col("item"))
    raw_name = {v: n for n, v in TEST_EVENT_NAMES.items()}

    def of(stream, key):
        return rows.filter(F.col("raw_type") == raw_name[stream]).select("client_id", "event_ts", key)

    return Streams(
        buy=of("product_buy", F.col("item").alias("sku")),
        add=of("add_to_cart", F.col("item").alias("sku")),
        remove=of("remove_from_cart", F.col("item").alias("sku")),
        visit=of("page_visit", F.col("k").alias("url")),
        search=of("search_query", F.col("k").cast("string").alias("query")),
        products=products_from_parts(spark, sf_dir),
        tagged=rows.select("client_id", "event_ts", "event_type", sku.alias("sku")),
    )


def products_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_dimension(raw_products(spark, sf_dir))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test ``part`` table with the columns of the product source."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("sku"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("category"),
        ((F.col("p_size") - 1) * 2).cast("bigint").alias("price"),
        F.col("p_name").alias("name"),
    )


def write_raw(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The test tables as the six source files, times as text: what ``read_streams`` reads."""
    streams = from_event_table(spark, sf_dir)
    for name, df in streams.by_type().items():
        raw = df.withColumn("timestamp", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).drop("event_ts")
        raw.write.parquet(f"{folder}/{name}.parquet")
    raw_products(spark, sf_dir).write.parquet(f"{folder}/product_properties.parquet")


def purchases_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as purchases: a long history with several lines per checkout."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("event_ts"),
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").alias("sku"))
    return orders.join(lines, "l_orderkey").select("client_id", "event_ts", "sku")
