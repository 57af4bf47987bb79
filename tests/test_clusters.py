import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tidemark.functions.dialect import parse_vector
from tidemark.operators import clusters


def test_search_links_equal_the_join_for_a_hot_client(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)

    def who():
        return 1 if rng.random() < 0.35 else rng.randrange(2, 25)

    def when():
        # few instants, so searches and purchases often coincide
        return start + timedelta(hours=rng.randrange(120))

    search = [(who(), when(), rng.randrange(4)) for _ in range(400)]
    buy = [(who(), when(), rng.randrange(12)) for _ in range(300)]
    category = {k: k % 3 for k in range(10)}
    got = clusters.search_to_purchase(
        spark.createDataFrame(search, "client_id bigint, event_ts timestamp_ntz, cluster int"),
        spark.createDataFrame(buy, "client_id bigint, event_ts timestamp_ntz, sku bigint"),
        spark.createDataFrame(list(category.items()), "sku bigint, category bigint"),
    )
    want = Counter(
        (k, category[sku]) for c, t, k in search for b, u, sku in buy if b == c and u > t and sku in category
    )
    assert {(r.cluster, r.category): r.n for r in got.collect()} == dict(want)


def test_agreement_extremes(spark):
    rows = [(k % 4, (k % 4) * 10, 7) for k in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    r = clusters.agreement(df, "a", "b").collect()[0]
    assert r.nmi == pytest.approx(1.0) and r.ari == pytest.approx(1.0)
    r = clusters.agreement(df, "a", "c").collect()[0]
    assert r.nmi == pytest.approx(0.0) and r.ari == pytest.approx(0.0)
    r = clusters.agreement(df, "c", "c").collect()[0]
    assert r.nmi == 1.0 and r.ari == 1.0


def test_kmeans_finds_planted_groups(spark):
    rng = random.Random(1)
    rows = [(k, [10.0 * (k % 3) + rng.gauss(0, 0.1), rng.gauss(0, 0.1)], k % 3) for k in range(90)]
    df = spark.createDataFrame(rows, "id int, v array<float>, label int")
    r = clusters.agreement(clusters.cluster(df, "v", 3), "label", "cluster").collect()[0]
    assert r.nmi == pytest.approx(1.0) and r.ari == pytest.approx(1.0)
    costs = clusters.inertia_by_k(df, "v", [2, 3]).orderBy("k").collect()
    assert costs[0].drop_pct is None and costs[1].drop_pct > 90


def test_parse_vector(spark):
    df = spark.createDataFrame([("[1 2   3]",), (" [ 4 x ] ",), ("[]",), (None,)], "t string")
    got = [r.v for r in df.select(parse_vector("t").alias("v")).collect()]
    assert got == [[1.0, 2.0, 3.0], [4.0, None], [], None]


def test_purity_ties_go_by_label(spark):
    df = spark.createDataFrame([(1, 5), (1, 4), (1, 4), (1, 5), (1, 9), (2, 1)], "cluster int, category int")
    rows = {r.cluster: r for r in clusters.purity(df, "cluster", "category", 2).orderBy("cluster").collect()}
    assert rows[1].top2 == "4:2, 5:2" and rows[1].top1_pct == 40.0 and rows[1].n_distinct_labels == 3
    assert rows[2].top2 == "1:1"
    assert df.select(F.count("*")).first()[0] == 6


def test_all_starts_take_their_steps_in_shared_passes(spark, monkeypatch):
    """Centres and cost are those of Spark's own runs, with no Lloyd step of Spark's."""
    rng = random.Random(3)
    rows = [(k, [rng.gauss(k % 7, 0.8) for _ in range(3)]) for k in range(600)]
    points = clusters.vectors(spark.createDataFrame(rows, "id int, v array<float>"), "v").select("_v", "_x").cache()
    plain = {n: KMeans(featuresCol="_v", k=5, seed=42 + n, maxIter=300, tol=1e-4).fit(points) for n in range(3)}
    steps, lloyd = [], clusters.KMeans
    monkeypatch.setattr(clusters, "KMeans", lambda **kw: steps.append(kw["maxIter"]) or lloyd(**kw))
    starts = {n: clusters._starting_centres(points, 5, 42 + n) for n in range(3)}
    runs = clusters._lloyd(points, starts, 300)
    for n, model in plain.items():
        assert runs[n][1] == pytest.approx(model.summary.trainingCost, rel=1e-9)
        assert runs[n][0] == pytest.approx(np.array(model.clusterCenters()), abs=1e-9)
    clusters.cluster(spark.createDataFrame(rows, "id int, v array<float>"), "v", 5).count()
    assert steps and not any(steps)
