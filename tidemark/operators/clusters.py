"""Clusters of embedding vectors, how they agree with given labels, and what follows a search."""

from __future__ import annotations

import operator
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import day, ratio
from ..plans.joins import spread_lookup
from ..plans.materialize import materialize

#: Numbers of clusters tried for the elbow.
K_CANDIDATES = (5, 10, 20, 30, 50, 75, 100, 150)


#: Vectors whose distances to all centres are worked out at once.
BLOCK = 4096


def vectors(rows: DataFrame, column: str) -> DataFrame:
    """Adds the vectors twice: ``_v`` for Spark's k-means, ``_x`` as an array."""
    x = F.col(column).cast("array<double>")
    return rows.withColumn("_v", array_to_vector(x)).withColumn("_x", x)


def _starting_centres(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """Centres that Spark's k-means starts from: its parallel k-means++ without a Lloyd step."""
    return np.array(KMeans(featuresCol="_v", k=k, seed=seed, maxIter=0).fit(points).clusterCenters())


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance to it."""
    d = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    own = d.argmin(axis=1)
    return own, np.maximum(d[np.arange(len(x)), own] + (x * x).sum(axis=1), 0)


def _blocks(points: DataFrame) -> RDD:
    """The vectors as matrices of up to ``BLOCK`` rows, spread over all cores and kept there."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.column(0).slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([len(part)], pa.int32())],
                    names=["x", "n"],
                )

    cores = points.sparkSession.sparkContext.defaultParallelism
    dealt = points.select("_x").repartition(cores).mapInArrow(run, "x binary, n int")
    blocks = dealt.rdd.map(lambda r: np.frombuffer(r.x, np.float64).reshape(r.n, -1))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _lloyd(points: DataFrame, starts: dict, max_iter: int, tol: float = 1e-4) -> dict:
    """Per key of ``starts``: centres after Lloyd steps, and the cost before the last of them.

    All keys take their step in one pass over the vectors, and those whose centres all moved
    by ``tol`` or less leave. Sums are added up by key on the executors, so a step brings
    one matrix of centres per key to the driver, however many vectors there are.
    """
    blocks = _blocks(points)
    now, costs, live = dict(starts), dict.fromkeys(starts, 0.0), list(starts)

    def step(moving):
        def sums(parts):
            found = {}
            for x in parts:
                for key, centres in moving.value.items():
                    own, cost = _nearest(x, centres)
                    of = np.zeros((len(x), len(centres)))
                    of[np.arange(len(x)), own] = 1
                    new = (of.T @ x, of.sum(axis=0), cost.sum())
                    found[key] = tuple(map(operator.add, found[key], new)) if key in found else new
            return iter(found.items())

        def centres(entry):
            key, (total, n, cost) = entry
            old = moving.value[key]
            return key, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old), cost

        added = blocks.mapPartitions(sums).reduceByKey(lambda a, b: tuple(map(operator.add, a, b)), len(live))
        return added.map(centres).collect()  # as many matrices as keys

    try:
        for _ in range(max_iter):
            if not live:
                break
            moving = blocks.context.broadcast({key: now[key] for key in live})
            for key, new, cost in step(moving):
                if (((new - now[key]) ** 2).sum(axis=1) <= tol * tol).all():
                    live.remove(key)
                now[key], costs[key] = new, float(cost)
            moving.unpersist()
    finally:
        blocks.unpersist()
    return {key: (now[key], costs[key]) for key in starts}


def _best_kmeans(points: DataFrame, ks: Sequence[int], seed: int, n_starts: int, max_iter: int) -> dict[int, tuple[np.ndarray, float]]:
    """Per k the centres and cost of the cheapest of ``n_starts`` runs; Lloyd steps go on until no centre moves by 1e-4."""
    starts = {(k, n): _starting_centres(points, k, seed + n) for k in ks for n in range(n_starts)}
    runs = _lloyd(points, starts, max_iter)
    return {k: min((runs[k, n] for n in range(n_starts)), key=lambda run: run[1]) for k in ks}


def inertia_by_k(
    rows: DataFrame, column: str, ks: Sequence[int] = K_CANDIDATES, seed: int = 42, n_starts: int = 3, max_iter: int = 300
) -> DataFrame:
    """Sum of squared distances per k and its fall from the k before, in %."""
    points = materialize(vectors(rows, column).select("_v", "_x"))
    runs = _best_kmeans(points, ks, seed, n_starts, max_iter)
    costs = [(k, runs[k][1]) for k in ks]
    w = Window.partitionBy(F.lit(1)).orderBy("k")
    out = rows.sparkSession.createDataFrame(costs, "k int, inertia double")
    prev = F.lag("inertia").over(w)
    return out.withColumn("drop_pct", ratio(prev - F.col("inertia"), prev, 100))


def cluster(rows: DataFrame, column: str, k: int = 50, seed: int = 42, n_starts: int = 10, max_iter: int = 300) -> DataFrame:
    """Add the number of the nearest of ``k`` centres."""
    points = materialize(vectors(rows, column))
    centres, _ = _best_kmeans(points, [k], seed, n_starts, max_iter)[k]

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(x.to_numpy()), centres)[0].astype(np.int32))

    return points.withColumn("cluster", nearest("_x")).drop("_v", "_x")


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean) and adjusted Rand index of two labelings.

    Everything follows from the table of label pairs.
    """
    cells = materialize(rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    row = cells.groupBy("a").agg(F.sum("n").alias("na"))
    col = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n")).scalar()
    full = cells.join(row, "a").join(col, "b").withColumn("t", total.cast("double"))
    n, na, nb, t = (F.col(c).cast("double") for c in ("n", "na", "nb", "t"))

    def pairs(x):
        return x * (x - 1) / 2

    def entropy(frame, c, name):
        share = F.col(c).cast("double") / F.col("t")
        return frame.withColumn("t", total.cast("double")).agg(
            F.sum(-share * F.log(share)).alias(f"h_{name}"), F.sum(pairs(F.col(c).cast("double"))).alias(f"pairs_{name}")
        )

    joint = full.agg(
        F.sum(n / t * F.log(n * t / (na * nb))).alias("mi"), F.sum(pairs(n)).alias("pairs"), F.max("t").alias("t")
    )
    ha, hb = entropy(row, "na", "a"), entropy(col, "nb", "b")
    one = joint.select(
        "*",
        ha.select(F.struct("h_a", "pairs_a")).scalar().alias("x"),
        hb.select(F.struct("h_b", "pairs_b")).scalar().alias("y"),
    ).select("mi", "pairs", "t", "x.h_a", "x.pairs_a", "y.h_b", "y.pairs_b")
    expected = F.col("pairs_a") * F.col("pairs_b") / pairs(F.col("t"))
    best = (F.col("pairs_a") + F.col("pairs_b")) / 2
    mean_h = (F.col("h_a") + F.col("h_b")) / 2
    # one cluster on both sides, or all singletons on both sides, is perfect agreement
    return one.select(
        F.when(mean_h > 0, F.greatest(F.col("mi"), F.lit(0.0)) / mean_h).otherwise(F.lit(1.0)).alias("nmi"),
        F.when(best != expected, (F.col("pairs") - expected) / (best - expected)).otherwise(F.lit(1.0)).alias("ari"),
    )


def top_labels(cells: DataFrame, cluster_col: str, label: str, k: int) -> DataFrame:
    """Per cluster: size, distinct labels, share of the largest, and the ``k`` largest as text.

    ``cells`` holds ``n`` per (cluster, label); equal counts go by label.
    """
    whole = Window.partitionBy(cluster_col)
    order = whole.orderBy(F.col("n").desc(), label)
    ranked = cells.select(
        cluster_col,
        label,
        "n",
        F.row_number().over(order).alias("rank"),
        F.sum("n").over(whole).alias("total"),
    )
    text = F.format_string("%s:%d", F.col(label).cast("string"), F.col("n"))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", text.alias("text")))))
    return ranked.groupBy(cluster_col).agg(
        F.max("total").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct_labels"),
        (F.max("n") / F.max("total") * 100).alias("top1_pct"),
        F.array_join(F.transform(top, lambda x: x["text"]), ", ").alias(f"top{k}"),
    )


def purity(rows: DataFrame, cluster_col: str, label: str, k: int = 3) -> DataFrame:
    cells = rows.groupBy(cluster_col, label).agg(F.count(F.lit(1)).alias("n"))
    return top_labels(cells, cluster_col, label, k)


def searching_buyers(search: DataFrame, buy: DataFrame) -> DataFrame:
    """Clients with both a search and a purchase."""
    return search.select("client_id").distinct().join(buy.select("client_id").distinct(), "client_id", "left_semi")


def search_to_purchase(search: DataFrame, buy: DataFrame, products: DataFrame) -> DataFrame:
    """``(cluster, category, n)``: purchases that came after a search of the same client.

    Every purchase counts once per earlier search of a cluster, as if joined, but nothing is
    paired. Per client and cluster the searches of earlier days are a running count over the
    days, and inside a day a running count over that day's events. A purchase is repeated at
    most once per cluster.
    """
    s = search.filter(F.col("event_ts").isNotNull()).select("client_id", "cluster", "event_ts")
    known = spread_lookup(
        buy.filter(F.col("event_ts").isNotNull()), products.select("sku", "category"), ["sku"], ["client_id", "event_ts"]
    )
    searched = s.select("client_id", "cluster").distinct().groupBy("client_id").agg(F.collect_list("cluster").alias("clusters"))
    per_ts = known.groupBy("client_id", "event_ts", "category").agg(F.count(F.lit(1)).alias("n"))
    buys = spread_lookup(per_ts, searched, ["client_id"], ["event_ts"]).select(
        "client_id", F.explode("clusters").alias("cluster"), "event_ts", "category", "n"
    )
    zero = F.lit(0).cast("bigint")
    rows = (
        s.select("client_id", "cluster", "event_ts", F.lit(None).cast("bigint").alias("category"), zero.alias("n"), F.lit(1).alias("searched"))
        .unionByName(buys.withColumn("category", F.col("category").cast("bigint")).withColumn("searched", F.lit(0)))
        .withColumn("d", day("event_ts"))
    )
    # same day: a purchase sorts before a search of the same instant, so only earlier ones count
    in_day = Window.partitionBy("client_id", "cluster", "d").orderBy("event_ts", "searched")
    same_day = (
        rows.withColumn("before", F.sum("searched").over(in_day.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("searched") == 0)
        .select("cluster", "category", (F.col("n") * F.col("before")).alias("links"))
    )
    per_day = rows.groupBy("client_id", "cluster", "d", F.when(F.col("searched") == 0, F.col("category")).alias("category"), "searched").agg(
        F.sum("n").alias("n"), F.sum("searched").alias("k")
    )
    by_day = Window.partitionBy("client_id", "cluster").orderBy(F.unix_date("d")).rangeBetween(Window.unboundedPreceding, -1)
    earlier = (
        per_day.withColumn("before", F.coalesce(F.sum("k").over(by_day), F.lit(0)))
        .filter(F.col("searched") == 0)
        .select("cluster", "category", (F.col("n") * F.col("before")).alias("links"))
    )
    return (
        same_day.unionByName(earlier)
        .groupBy("cluster", "category")
        .agg(F.sum("links").alias("n"))
        .filter(F.col("n") > 0)
    )


def search_purchase_mix(search: DataFrame, links: DataFrame, k: int = 5) -> DataFrame:
    """Per search cluster: searches, linked purchases, categories and the ``k`` largest."""
    mix = top_labels(links, "cluster", "category", k)
    sizes = search.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_search_events"))
    return mix.join(sizes, "cluster").select(
        "cluster",
        "n_search_events",
        F.col("n_rows").alias("n_linked_purchases"),
        F.col("n_distinct_labels").alias("n_distinct_categories"),
        F.col("top1_pct").alias("top1_category_pct"),
        F.col(f"top{k}").alias(f"top{k}_categories"),
    )


def overall_category_share(links: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` categories most often linked, with their share of all links."""
    per_category = links.groupBy("category").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return (
        per_category.withColumn("pct", ratio(F.col("n"), total, 100))
        .orderBy(F.col("n").desc(), "category")
        .limit(k)
    )
