"""A layered build that grows by increments and is published whole or not at all.

Every build writes to a folder of its own and ends by publishing a manifest: which days the
hub has and where, which snapshot dates the panels have and where, and where each other
table is. Readers follow the newest manifest, so a build that dies changes nothing, and
tables that are being read stay as they are until ``vacuum``.

* Events are staged by day. New events touch days and clients.
* The hub, one row per client and day, is worked out anew for touched days only. It is
  stored in one partition per day, bucketed by client, and opened as one table over the
  days of all builds, so that what groups, windows or joins it by client shuffles nothing.
* Tables with rows of a client that depend on that client alone are worked out anew for
  touched clients; the other rows are carried over.
* Panels are worked out anew from the first snapshot date that a touched day can reach with
  its label; earlier dates stay where they are. If the log now begins on an earlier day, the
  grid moves and all dates are made again.
* Tables that look at the end of the log or at all customers are made from the tables above.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import day
from ..operators import facts, marts, panel
from ..params import Params
from ..plans.rollup import client_days
from .streams import Streams

NO_DAY = "none"
#: Rows of a client that follow from its own events.
CLIENT: dict[str, Callable[[Streams, Params], DataFrame]] = {
    "int_client_rollup": lambda s, p: marts.client_rollup(s),
    "int_purchase_gap": lambda s, p: facts.purchase_gap(s.buy),
    "int_cart_pair": lambda s, p: facts.cart_pairs(s),
    "int_category_start": lambda s, p: panel.category_starts(s),
}
DATED: dict[str, Callable[[Streams, Params, date | None], DataFrame]] = {
    "int_population": lambda s, p, since: panel.population(s, p, since),
    "mart_customer_snapshot": lambda s, p, since: panel.customer_snapshot(s, p, since=since),
    "mart_purchase_propensity": lambda s, p, since: panel.purchase_propensity(s, p, since=since),
}
WHOLE: dict[str, Callable[[Streams, Params], DataFrame]] = {
    "mart_customer_360": lambda s, p: marts.customer_360(s, p),
    "mart_customer_lifecycle": lambda s, p: marts.customer_lifecycle(s, p),
    "mart_customer_segment": lambda s, p: marts.customer_segment(s, p),
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class Store:
    """Tables under ``folder``, which all executors must reach; ``buckets`` is fixed by the first build."""

    def __init__(self, spark: SparkSession, folder: str, p: Params, buckets: int = 16):
        self.spark, self.folder, self.p = spark, folder.rstrip("/"), p
        self.buckets = (self.manifest() or {}).get("buckets", buckets)

    # -- manifests

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_manifests")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """The newest published one."""
        jvm, path, fs = self._files()
        if not fs.exists(path):
            return None
        names = sorted(f.getPath().getName() for f in fs.listStatus(path))
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return None
        text = self.spark.read.text(f"{self.folder}/_manifests/{names[-1]}", wholetext=True).first()
        return json.loads(text["value"])

    def _publish(self, manifest: dict) -> None:
        """Written beside and renamed, which readers see at once or not at all; one of two rivals fails."""
        jvm, path, fs = self._files()
        fs.mkdirs(path)
        draft = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}")
        final = jvm.org.apache.hadoop.fs.Path(path, f"{manifest['version']:08d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} has been published by another build")

    # -- reading

    def hub(self, manifest: dict | None = None) -> DataFrame:
        """One row per client and day of all published days, bucketed by client."""
        manifest = manifest or self.manifest()
        name = f"tidemark_hub_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({manifest['hub_schema']}, day_key STRING) USING parquet PARTITIONED BY (day_key) "
            f"CLUSTERED BY (client_id) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/_hub'"
        )
        parts = " ".join(f"PARTITION (day_key = '{k}') LOCATION '{where}/day_key={k}'" for k, where in manifest["days"].items())
        self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
        return self.spark.table(name).drop("day_key")

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A published table."""
        manifest = manifest or self.manifest()
        if name == "int_client_day":
            return self.hub(manifest)
        if name in manifest["dates"]:
            schema, places = manifest["schemas"][name], manifest["dates"][name]
            by_place: dict[str, list[str]] = {}
            for d, where in places.items():
                by_place.setdefault(where, []).append(d)
            read = self.spark.read.schema(schema)
            parts = [read.parquet(w).filter(F.col("snapshot_date").isin([date.fromisoformat(d) for d in ds])) for w, ds in by_place.items()]
            return _union(parts) if parts else self.spark.createDataFrame([], schema)
        return self.spark.read.schema(manifest["schemas"][name]).parquet(manifest["tables"][name])

    def _staged(self, manifest: dict, keys: list[str] | None = None) -> dict[str, DataFrame]:
        """Staged events by type, of certain days only where asked."""
        out = {}
        for kind, places in manifest["staged"].items():
            rows = _union([self.spark.read.schema(manifest["schemas"][f"stg_{kind}"]).parquet(w) for w in places])
            rows = rows if keys is None else rows.filter(F.col("day_key").isin(keys))
            out[kind] = rows.drop("day_key")
        return out

    def _streams(self, staged: dict[str, DataFrame], products: DataFrame, **tables) -> Streams:
        return Streams(
            buy=staged["product_buy"], add=staged["add_to_cart"], remove=staged["remove_from_cart"],
            visit=staged["page_visit"], search=staged["search_query"], products=products, **tables,
        )

    # -- building

    def _write(self, manifest: dict, folder: str, name: str, df: DataFrame, by: str | None = None) -> str:
        where = f"{folder}/{name}"
        writer = df.write if by is None else df.write.partitionBy(by)
        writer.parquet(where)
        manifest["schemas"][name] = _ddl(df)
        return where

    def _add_hub(self, manifest: dict, folder: str, rows: DataFrame, keys: list[str]) -> None:
        """Write days of the hub, one file per day and bucket, and note where they are."""
        manifest["hub_schema"] = _ddl(rows)
        keyed = rows.withColumn("day_key", F.coalesce(F.col("d").cast("string"), F.lit(NO_DAY)))
        name, where = f"tidemark_part_{uuid.uuid4().hex}", f"{folder}/int_client_day"
        # dealt as buckets are, so that a task writes a single one
        dealt = keyed.repartition(self.buckets, "client_id").sortWithinPartitions("day_key", "client_id")
        writer = dealt.write.partitionBy("day_key").bucketBy(self.buckets, "client_id").sortBy("client_id")
        writer.option("path", where).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        for k in keys:
            manifest["days"][k] = where

    def add(self, new: Streams) -> dict:
        """Stage new events, bring all tables up to date, publish, and return the manifest."""
        p, spark = self.p, self.spark
        old = self.manifest()
        manifest = json.loads(json.dumps(old)) if old else {"version": 0, "days": {}, "dates": {}, "tables": {}, "schemas": {}, "staged": {}}
        manifest |= {"version": manifest["version"] + 1, "buckets": self.buckets}
        folder = f"{self.folder}/build-{manifest['version']:08d}-{uuid.uuid4().hex}"
        for kind, df in new.by_type().items():
            keyed = df.withColumn("day_key", F.coalesce(day("event_ts").cast("string"), F.lit(NO_DAY)))
            where = self._write(manifest, folder, f"stg_{kind}", keyed.repartition("day_key", F.pmod(F.xxhash64("client_id"), F.lit(4))), "day_key")
            manifest["staged"][kind] = [*manifest["staged"].get(kind, []), where]
        manifest["tables"]["stg_products"] = self._write(manifest, folder, "stg_products", new.products)
        products = self.table("stg_products", manifest)

        fresh = {k: spark.read.schema(manifest["schemas"][f"stg_{k}"]).parquet(w[-1]) for k, w in manifest["staged"].items()}
        touched_days = _union([df.select("day_key") for df in fresh.values()]).distinct()
        keys = sorted(r["day_key"] for r in touched_days.collect())  # as many as days
        if not keys:
            if old is None:
                raise ValueError("the first build has no events")
            return old
        who = _union([df.select("client_id") for df in fresh.values()]).distinct()
        touched = spark.read.schema("client_id bigint").parquet(self._write(manifest, folder, "touched", who)).select(F.col("client_id").alias("_c"))
        mine = F.col("client_id").eqNullSafe(F.col("_c"))

        before = sorted(k for k in manifest["days"] if k != NO_DAY)
        today = self._streams(self._staged(manifest, keys), products)
        self._add_hub(manifest, folder, client_days(today.events, today.buy), keys)
        hub = self.hub(manifest)
        staged = self._staged(manifest)

        # rows of touched clients from their own events, the others carried over
        own = {k: df.join(touched, mine, "left_semi") for k, df in staged.items()}
        theirs = self._streams(own, products, day_table=hub.join(touched, mine, "left_semi"))
        for name, make in CLIENT.items():
            rows = make(theirs, p)
            if name in manifest["tables"]:
                rows = rows.unionByName(self.table(name, old).join(touched, mine, "left_anti"))
            manifest["tables"][name] = self._write(manifest, folder, name, rows)

        streams = self._streams(
            staged, products, day_table=hub,
            rollup_table=self.table("int_client_rollup", manifest),
            cart_pair_table=self.table("int_cart_pair", manifest),
            category_start_table=self.table("int_category_start", manifest),
        )
        known = [k for k in keys if k != NO_DAY]
        since = self._since(manifest, before, known)
        for name, make in DATED.items():
            kept = {d: w for d, w in manifest["dates"].get(name, {}).items() if since is not None and d < since.isoformat()}
            where = self._write(manifest, folder, name, make(streams, p, since).repartition("snapshot_date", F.pmod(F.xxhash64("client_id"), F.lit(4))), "snapshot_date")
            made = spark.read.schema(manifest["schemas"][name]).parquet(where).select("snapshot_date").distinct().collect()
            manifest["dates"][name] = kept | {r["snapshot_date"].isoformat(): where for r in made}
        for name, make in WHOLE.items():
            manifest["tables"][name] = self._write(manifest, folder, name, make(streams, p))
        self._publish(manifest)
        return manifest

    def _since(self, manifest: dict, before: list[str], touched: list[str]) -> date | None:
        """First snapshot date to make again; None for all of them."""
        dates = [d for places in manifest["dates"].values() for d in places]
        if not dates or not touched or not before or touched[0] < before[0]:
            return None
        last = date.fromisoformat(max(dates)) + timedelta(days=1)
        return min(last, date.fromisoformat(touched[0]) - timedelta(days=max(self.p.label_days)))

    def vacuum(self) -> int:
        """Delete what the newest manifest does not name, and older manifests; nobody may be reading those."""
        manifest = self.manifest()
        named = json.dumps(manifest)
        jvm, path, fs = self._files()
        root, done = path.getParent(), 0
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("build-") and name not in named:
                done += bool(fs.delete(f.getPath(), True))
        for f in fs.listStatus(path):
            if f.getPath().getName() != f"{manifest['version']:08d}.json":
                fs.delete(f.getPath(), False)
        return done


def build_in_steps(streams: Streams, p: Params, folder: str, cuts: list[date], buckets: int = 16) -> Store:
    """A store built from the days before, between and after ``cuts``, one increment each."""
    spark = streams.products.sparkSession
    store = Store(spark, folder, p, buckets)
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):

        def within(df, lo=lo, hi=hi):
            d = day("event_ts")
            inside = (F.lit(True) if lo is None else d >= F.lit(lo)) & (F.lit(True) if hi is None else d < F.lit(hi))
            return df.filter(F.coalesce(inside, F.lit(lo is None)))

        kinds = {name: within(getattr(streams, name)) for name in ("buy", "add", "remove", "visit", "search")}
        store.add(replace(streams, **kinds, tagged=None, day_table=None))
    return store
