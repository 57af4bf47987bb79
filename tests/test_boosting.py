"""Boosted trees against a plain implementation, Spark's own trees, and planted signals."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import Boosting, binned, best_round

B = Boosting(rounds=8, leaves=6, depth=4, min_rows=15, patience=30, keep=4)


def rows_of(n, seed=1, noise=0.1):
    """Three features, of which the second is missing for a third of the rows, and there y is 1 more often."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x = [rng.randrange(12), None if rng.random() < 0.33 else rng.random(), rng.choice((None, 1.0, 5.0, 9.0))]
        p = 0.15 + 0.5 * (x[1] is None) + 0.25 * (x[0] > 7) * (x[2] == 5.0)
        y = int(rng.random() < min(p, 1) * (1 - noise))
        out.append((rng.choice(("train", "train", "train", "val", "test")), k, [None if v is None else float(v) for v in x], y, int(x[0] > 5)))
    return out


SCHEMA = "split string, k long, x array<double>, y int, z int"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows_of(3000), SCHEMA).repartition(5).cache()


def plain_fit(bins, y, b, rounds):
    """The same trees by growing one leaf at a time on whole arrays."""
    p0 = y.mean()
    margin, trees = np.full(len(y), np.log(p0 / (1 - p0))), []

    def best(rows, g, h):
        top = None
        score = lambda m: g[m].sum() ** 2 / max(h[m].sum(), 1e-12)
        whole = score(rows)
        for f in range(bins.shape[1]):
            for cut in range(1, 256):
                for missing_left in (False, True):
                    left = rows & np.where(bins[:, f] == 0, missing_left, bins[:, f] <= cut)
                    right = rows & ~left
                    if min(left.sum(), right.sum()) < b.min_rows or min(h[left].sum(), h[right].sum()) < b.min_hessian:
                        continue
                    gain = score(left) + score(right) - whole
                    if gain > 1e-9 and (top is None or gain > top[0] + 1e-9):
                        top = (gain, left, right)
        return top

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = [(np.ones(len(y), bool), 0)]
        known = {0: best(leaves[0][0], g, h)}
        while len(leaves) < b.leaves:
            open_ = [(known[k][0], -k) for k, (rows, depth) in enumerate(leaves) if rows is not None and known[k] and depth < b.depth]
            if not open_:
                break
            k = -max(open_)[1]
            _, left, right = known[k]
            depth = leaves[k][1]
            leaves[k] = (left, depth + 1)
            leaves.append((right, depth + 1))
            known[k], known[len(leaves) - 1] = best(left, g, h), best(right, g, h)
        for rows, _ in leaves:
            margin[rows] -= b.step * g[rows].sum() / h[rows].sum()
        trees.append(margin.copy())
    return margin


@pytest.mark.parametrize("task", [60, 250_000])
def test_trees_equal_plain_growing(spark, monkeypatch, task):
    monkeypatch.setattr(boosting, "TASK", task)  # leaves above it are split by sums of all tasks
    rows = [r for r in rows_of(500, 7) if r[0] != "test"]
    b = Boosting(rounds=3, leaves=5, depth=3, min_rows=10, patience=30, keep=2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = boosting.fit(df, "x", 3, ["y"], b)["y"]
    train = [r for r in rows if r[0] == "train"]
    x = np.array([[np.nan if v is None else v for v in r[2]] for r in train])
    bins = binned(x, model.cuts)
    want = plain_fit(bins, np.array([r[3] for r in train], float), b, len(model.trees))
    got = model.prior + sum(t.margin(bins) for t in model.trees)
    assert np.allclose(got, want)
    scored = {r.k: r.s for r in df.filter("split = 'train'").withColumn("s", model.probability(F.col("x"))).collect()}
    assert np.allclose([scored[r[1]] for r in train], 1 / (1 + np.exp(-want)))


@pytest.mark.parametrize("task", [60, 250_000])
def test_one_task_and_passes_give_the_same_model(spark, monkeypatch, task):
    """Also where a larger child's sums are a difference, and with bins that no row of it has."""
    rows = [(s, k, x, None if k % 9 == 0 else y, z) for s, k, x, y, z in rows_of(900, 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    b = Boosting(rounds=6, leaves=7, depth=4, min_rows=10, patience=30, keep=4)
    passes = []
    plain = boosting._passed
    monkeypatch.setattr(boosting, "_passed", lambda *a: passes.append(1) or plain(*a))
    alone = boosting.fit(df, "x", 3, ["y", "z"], b)
    assert not passes
    monkeypatch.setattr(boosting, "LARGE", 50)
    less = boosting.fit(df, "x", 3, ["y", "z"], b)
    monkeypatch.setattr(boosting, "ALONE", 0)
    monkeypatch.setattr(boosting, "TASK", task)
    monkeypatch.setattr(boosting, "HELD", task)
    passed = boosting.fit(df, "x", 3, ["y", "z"], b)
    assert passes
    for other in (less, passed):
        # z is told by one split, the gains below it are those of rounding
        assert other["z"].trees[0].cut[0] == alone["z"].trees[0].cut[0] and other["z"].quality == pytest.approx(alone["z"].quality)
        own, theirs = alone["y"].trees, other["y"].trees
        assert [(t.feature, t.cut, t.missing_left) for t in theirs] == [(t.feature, t.cut, t.missing_left) for t in own]
        assert other["y"].quality == pytest.approx(alone["y"].quality)
        assert [v for t in theirs for v in t.value] == pytest.approx([v for t in own for v in t.value])


def test_area_under_the_curve():
    y, score = np.array([1, 0, 1, 0, 0, 1]), np.array([0.5, 0.5, 0.9, 0.1, 0.9, 0.2])
    pairs = [(a > b) + (a == b) / 2 for a in score[y == 1] for b in score[y == 0]]
    assert boosting.area(y, score) == sum(pairs) / 9
    assert boosting.area(y[:1], score[:1]) is None and boosting.area(y[:0], score[:0]) is None


def auc(df, column):
    return BinaryClassificationEvaluator(rawPredictionCol=column, labelCol="y").evaluate(df)


def test_not_worse_than_sparks_trees(frame):
    b = Boosting(rounds=30, min_rows=20, patience=30)
    model = boosting.fit(frame, "x", 3, ["y"], b)["y"]
    test = frame.filter("split = 'test'")
    own = auc(test.withColumn("s", model.probability(F.col("x"))), "s")
    filled = frame.withColumn("v", array_to_vector(F.transform("x", lambda v: F.coalesce(v, F.lit(-1.0)))))
    spark_model = GBTClassifier(featuresCol="v", labelCol="y", maxIter=30, maxDepth=5, seed=1).fit(filled.filter("split = 'train'"))
    theirs = auc(spark_model.transform(filled.filter("split = 'test'")), "rawPrediction")
    assert own >= theirs - 0.005 and own > 0.7
    assert model.gains().argmax() == 1


def test_missing_values_go_where_they_belong(spark):
    rng = random.Random(2)
    rows = [("train" if k % 4 else "val", k, [None if k % 3 == 0 else rng.random()], int(k % 3 == 0), 0) for k in range(600)]
    for flip in (False, True):
        data = [(s, k, x, 1 - y if flip else y, z) for s, k, x, y, z in rows]
        df = spark.createDataFrame(data, SCHEMA)
        model = boosting.fit(df, "x", 1, ["y"], Boosting(rounds=4, leaves=2, keep=2))["y"]
        assert model.quality[1] == 1.0 and len(model.trees) == 1
        p = {r.k: r.s for r in df.withColumn("s", model.probability(F.col("x"))).collect()}
        assert all((p[k] > 0.5) == bool(y) or abs(p[k] - 0.5) < 0.3 for _, k, _, y, _ in data)
        assert min(p[k] for _, k, _, y, _ in data if y) > max(p[k] for _, k, _, y, _ in data if not y)


def test_labels_in_lockstep_equal_each_alone(frame):
    both = boosting.fit(frame, "x", 3, ["y", "z"], B)
    for label in ("y", "z"):
        alone = boosting.fit(frame, "x", 3, [label], B)[label]
        assert [t.feature for t in alone.trees] == [t.feature for t in both[label].trees]
        assert alone.quality == pytest.approx(both[label].quality)


def test_the_best_round_is_kept(frame):
    b = Boosting(rounds=40, leaves=31, min_rows=2, step=0.8, patience=3, keep=4)
    model = boosting.fit(frame, "x", 3, ["y"], b)["y"]
    best, ended = best_round(model.quality, 3)
    assert ended and len(model.quality) < 40 and len(model.trees) == best
    val = frame.filter("split = 'val'")
    assert auc(val.withColumn("s", model.probability(F.col("x"))), "s") == pytest.approx(model.quality[best])


def test_patience():
    rising = {n: n / 100 for n in range(1, 21)}
    assert best_round(rising, 5) == (20, False)
    assert best_round({**rising, **{n: 0.1 for n in range(21, 26)}}, 5) == (20, True)
    assert best_round({1: 0.5, 2: 0.7, 3: 0.7, 4: 0.6, 5: 0.9}, 3) == (5, False)
    assert best_round({1: 0.5, 2: 0.7, 3: 0.7, 4: 0.6, 5: 0.6, 6: 0.9}, 3) == (2, True)
    assert best_round({1: None, 2: None}, 5) == (1, False)


def test_odd_frames(spark, frame):
    for df in (frame.limit(0), frame.filter("y = 1"), frame.withColumn("y", F.lit(None).cast("int"))):
        model = boosting.fit(df, "x", 3, ["y"], B)["y"]
        assert model.trees == ()
        assert df.withColumn("s", model.probability(F.col("x"))).filter("s is null").count() == 0
    no_val = boosting.fit(frame.filter("split = 'train'"), "x", 3, ["y"], B)["y"]
    assert len(no_val.trees) == 1
    constant = frame.withColumn("x", F.array(*[F.lit(None).cast("double")] * 3))
    assert len(boosting.fit(constant, "x", 3, ["y"], B)["y"].trees) == 1
