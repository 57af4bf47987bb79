import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.plans import ranking

G = ["method"]


def scored_rows(kind, n=700, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if kind == "ties":  # a third of all rows share one score
            score = 0.5 if rng.random() < 0.34 else round(rng.random(), 2)
        elif kind == "constant":
            score = 0.5
        elif kind == "negative":
            score = rng.uniform(-3, 3)
        else:
            score = rng.random()
        rows.append((kind, "2024-01-08", c, int(rng.random() < 0.2 + 0.3 * (score > 0.6)), score))
    return rows


KINDS = ("ties", "constant", "spread", "negative")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [r for k in KINDS for r in scored_rows(k)]
    df = spark.createDataFrame(rows, "method string, snapshot_date string, client_id bigint, y int, score double")
    return df.repartition(5).cache()


def ordered(kind):
    def key(r):
        return (-r[4], hashlib.md5(f"{r[1]}|{r[2]}".encode()).hexdigest())

    return sorted(scored_rows(kind), key=key)


def test_value_slice_never_falls(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=2000), 10.0 ** rng.uniform(-320, 300, 2000), -(10.0 ** rng.uniform(-300, 300, 2000)), [0.0, 1.0, 0.5, 5e-324]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", ranking.value_slice("v").alias("s"))
    rows = sorted(map(tuple, df.collect()))
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))


def test_prefix_counts(spark):
    rng = random.Random(4)
    rows = {(g, round(rng.uniform(-5, 5), 2)): rng.randrange(1, 5) for g in "ab" for _ in range(300)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in rows.items()], "g string, v double, n bigint")
    for down in (True, False):
        for r in ranking.prefix_counts(df, ["g"], "v", ["n"], descending=down).collect():
            earlier = sum(n for (g, v), n in rows.items() if g == r.g and ((v > r.v) if down else (v < r.v)))
            assert r.n_before == earlier
            assert r.n_total == sum(n for (g, _), n in rows.items() if g == r.g)


def test_exact_quantiles(spark, scored):
    probs = [0.0, 0.1, 0.5, 0.77, 0.9, 1.0]
    got = {(r.method, r.prob): r.quantile for r in ranking.exact_quantiles(scored, "score", probs, G).collect()}
    for k in KINDS:
        values = [r[4] for r in scored_rows(k)]
        for q in probs:
            assert got[(k, q)] == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_quantiles_leave_out_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert ranking.exact_quantiles(df, "v", [0.5]).collect()[0].quantile == 2.0


@pytest.mark.parametrize("floor", [False, True])
def test_selection_at_rates(scored, floor):
    rates = [0.05, 1, 5, 10, 33, 50, 100]
    got = {(r.method, r.rate): r for r in metrics.selected_at(scored, G, rates, floor=floor).collect()}
    for kind in KINDS:
        order = ordered(kind)
        for x in rates:
            size = len(order) * x / 100
            k = max(1, math.floor(size) if floor else round(size))
            row = got[(kind, float(x))]
            assert (row.n_selected, row.n_captured) == (k, sum(r[3] for r in order[:k]))


def test_lift_curve_at_every_percent(scored):
    got = {(r.method, r.pct): r for r in metrics.lift_curve(scored, G).collect()}
    assert len(got) == 100 * len(KINDS)
    for kind in KINDS:
        order = ordered(kind)
        base = sum(r[3] for r in order) / len(order)
        for pct in range(1, 101):
            k = max(1, len(order) * pct // 100)
            row = got[(kind, pct)]
            assert row.n_selected == k and row.lift == pytest.approx(sum(r[3] for r in order[:k]) / k / base)


def test_lift_curve_of_a_tiny_group(spark):
    rows = [("m", "2024-01-08", c, int(c < 2), 1.0 - c / 10) for c in range(7)]
    df = spark.createDataFrame(rows, "method string, snapshot_date string, client_id bigint, y int, score double")
    got = {r.pct: r.n_selected for r in metrics.lift_curve(df, G).collect()}
    assert got == {pct: max(1, 7 * pct // 100) for pct in range(1, 101)}


def test_customers_needed(spark, scored):
    total = {k: sum(r[3] for r in scored_rows(k)) for k in KINDS}
    goals = [(k, x, t) for k in KINDS for x, t in enumerate((0, 1, 7, total[k] // 2, total[k]))]
    targets = spark.createDataFrame(goals, "method string, rate int, target bigint")
    got = {(r.method, r.rate): r.n_needed for r in metrics.needed_for(scored, G, targets).collect()}
    for kind, x, t in goals:
        hits = np.cumsum([r[3] for r in ordered(kind)])
        assert got[(kind, x)] == (1 if t == 0 else int(np.searchsorted(hits, t)) + 1)


def test_auc_and_average_precision(scored):
    got = {r.method: r for r in metrics.ranking_quality(scored, G).collect()}
    for kind in KINDS:
        rows = scored_rows(kind)
        pos, neg = [r[4] for r in rows if r[3]], [r[4] for r in rows if not r[3]]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[kind].roc_auc == pytest.approx(wins / len(pos) / len(neg))
        ap, seen = 0.0, 0
        for s in sorted({r[4] for r in rows}, reverse=True):
            top = [r[3] for r in rows if r[4] >= s]
            ap += (sum(top) - seen) / len(pos) * sum(top) / len(top)
            seen = sum(top)
        assert got[kind].pr_auc == pytest.approx(ap)
    assert got["constant"].roc_auc == 0.5


def test_no_positives(spark):
    rows = [("m", "2024-01-08", c, 0, c / 10) for c in range(10)]
    df = spark.createDataFrame(rows, "method string, snapshot_date string, client_id bigint, y int, score double")
    r = metrics.full_evaluation(df, G).collect()[0]
    assert r.roc_auc is None and r.pr_auc is None and r.recall_at_10pct == 0 and r.lift_at_10pct == 0
    targets = spark.createDataFrame([("m", 1, 0)], "method string, rate int, target bigint")
    assert metrics.needed_for(df, G, targets).collect()[0].n_needed == 10


def test_result_does_not_depend_on_partitioning(scored):
    a = metrics.full_evaluation(scored, G).orderBy("method").collect()
    b = metrics.full_evaluation(scored.repartition(13, F.rand(5)), G).orderBy("method").collect()
    for x, y in zip(a, b):
        assert [x[c] for c in x.asDict() if c != "method"] == pytest.approx([y[c] for c in y.asDict() if c != "method"])


def test_calibration_bins(scored):
    import pandas as pd

    got = metrics.calibration_table(scored.filter("method = 'ties'"), G).orderBy("bin").collect()
    df = pd.DataFrame([(r[3], r[4]) for r in scored_rows("ties")], columns=["y", "s"])
    want = df.groupby(pd.qcut(df.s, 10, duplicates="drop"), observed=True).agg(m=("s", "mean"), a=("y", "mean"), n=("y", "size"))
    assert [r.n for r in got] == list(want.n)
    assert [r.mean_predicted for r in got] == pytest.approx(list(want.m))
    assert [r.actual_rate for r in got] == pytest.approx(list(want.a))
