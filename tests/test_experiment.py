import math
import random
from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark import Params
from tidemark.functions import tails
from tidemark.operators import experiment

P = Params()


@pytest.fixture(scope="module")
def population(spark):
    rng = random.Random(9)
    rows = []
    for c in range(4000):
        # a third of the clients share the lowest score
        score = 0.1 if rng.random() < 0.33 else rng.random()
        rows.append((c, score, float(rng.randrange(90)), rng.randrange(6) if rng.random() < 0.9 else None))
    return spark.createDataFrame(rows, "client_id bigint, score double, days double, visits int").cache()


def pct_from_top(scores):
    order = sorted(scores)
    first = {}
    last = {}
    for k, s in enumerate(order, 1):
        first.setdefault(s, k)
        last[s] = k
    n = len(order)
    return {s: (1 - (first[s] + last[s]) / 2 / n) * 100 for s in first}


def test_bands_by_mean_rank(population):
    pct = pct_from_top([r.score for r in population.collect()])
    got = {r.client_id: r.segment for r in experiment.with_bands(population, "score", P).collect()}
    want = {}
    for r in population.collect():
        for name, lo, hi in P.score_bands:
            if lo <= pct[r.score] < hi:
                want[r.client_id] = name
    assert got == want and set(got.values()) == {"top_10", "10_30", "30_50"}


def test_arms_are_half_and_do_not_depend_on_partitioning(population):
    a = experiment.assign(population, "score", P)
    b = experiment.assign(population.repartition(17, F.rand(1)), "score", P)
    rows = {r.client_id: (r.segment, r.group) for r in a.collect()}
    assert rows == {r.client_id: (r.segment, r.group) for r in b.collect()}
    for name, _, _ in P.score_bands:
        arms = [g for s, g in rows.values() if s == name]
        assert arms.count("Treatment") == len(arms) // 2
    other = experiment.assign(population, "score", replace(P, seed=7))
    assert rows != {r.client_id: (r.segment, r.group) for r in other.collect()}


def test_balance_against_direct_computation(population):
    assigned = experiment.assign(population, "score", P).cache()
    got = {r.covariate: r for r in experiment.check_balance(assigned, ["days", "visits"]).collect()}
    for c in ("days", "visits"):
        t = [float(r[c]) for r in assigned.collect() if r.group == "Treatment" and r[c] is not None]
        k = [float(r[c]) for r in assigned.collect() if r.group == "Control" and r[c] is not None]
        u = sum((a > b) + 0.5 * (a == b) for a in t for b in k)
        assert got[c].statistic == pytest.approx(u)
        assert (got[c].n_treatment, got[c].n_control) == (len(t), len(k))
        n = len(t) + len(k)
        both = t + k
        ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
        sd = math.sqrt(len(t) * len(k) / 12 * (n + 1 - ties / (n * (n - 1))))
        z = (max(u, len(t) * len(k) - u) - len(t) * len(k) / 2 - 0.5) / sd
        assert got[c].p_value == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))
        assert got[c].balanced == (got[c].p_value >= 0.05)


def test_balance_with_an_empty_arm(spark):
    df = spark.createDataFrame([(1, "Treatment", 1.0), (2, "Treatment", 2.0)], "client_id bigint, group string, x double")
    r = experiment.check_balance(df, ["x"]).collect()[0]
    assert (r.n_treatment, r.n_control, r.statistic, r.p_value, r.balanced) == (2, 0, None, None, None)


def all_arrangements(u, n, m):
    """Two-sided p by listing which ranks the first arm may hold."""
    every = [sum(ranks) - n * (n - 1) / 2 for ranks in combinations(range(n + m), n)]
    extreme = max(u, n * m - u)
    return min(1.0, 2 * sum(x >= extreme for x in every) / len(every))


@pytest.mark.parametrize("n, m", [(1, 1), (1, 9), (2, 2), (3, 5), (5, 3), (4, 9), (8, 6), (8, 4)])
def test_exact_rank_test_against_every_arrangement(n, m):
    for u in range(0, n * m + 1, 1 + n * m // 12):
        assert tails.rank_two_sided(u, n, m) == pytest.approx(all_arrangements(u, n, m), rel=1e-12)


def test_exact_rank_test_against_published_tables():
    # largest U that is significant at 5 % on both sides, by sizes of the arms
    table = {(4, 4): 0, (5, 5): 2, (6, 6): 5, (7, 7): 8, (8, 8): 13, (5, 8): 6, (8, 20): 41, (3, 20): 8}
    for (n, m), u in table.items():
        assert tails.rank_two_sided(u, n, m) <= 0.05 < tails.rank_two_sided(u + 1, n, m)


def test_exact_rank_test_with_a_huge_arm():
    # one value among many: its place is uniform
    assert tails.rank_two_sided(12_345, 1, 10**9 - 1) == pytest.approx(2 * 12_346 / 10**9, rel=1e-12)
    # eight: U over the arm's size tends to a sum of eight uniform draws
    limit = sum((-1) ** k * math.comb(8, k) * (2.5 - k) ** 8 for k in range(3)) / math.factorial(8)
    assert tails.rank_two_sided(2.5e9, 8, 1e9) == pytest.approx(2 * limit, rel=1e-6)


def test_balance_of_small_arms_by_stratum(spark):
    rng = random.Random(4)
    rows = []
    for k, (stratum, n, m) in enumerate([("a", 3, 6), ("b", 8, 30), ("c", 9, 9), (None, 2, 5), ("e", 4, 0)]):
        rows += [(stratum, "Treatment" if j < n else "Control", rng.random() + k, 1.0) for j in range(n + m)]
    rows += [("tied", g, 1.0 + (j > 2), None) for g in ("Treatment", "Control") for j in range(4)]
    df = spark.createDataFrame(rows, "part string, group string, x double, y double")
    got = {(r.part, r.covariate): r for r in experiment.check_balance(df, ["x", "y"], ["part"]).collect()}
    assert len(got) == 12
    for part in ("a", "b", None):
        r = got[part, "x"]
        t = [x for p, g, x, _ in rows if p == part and g == "Treatment"]
        c = [x for p, g, x, _ in rows if p == part and g == "Control"]
        u = sum(a > b for a in t for b in c)
        assert (r.statistic, r.n_treatment, r.n_control, r.exact) == (u, len(t), len(c), True)
        assert r.p_value == pytest.approx(tails.rank_two_sided(u, len(t), len(c)))
        if len(t) < 8:
            assert r.p_value == pytest.approx(all_arrangements(u, len(t), len(c)))
    assert not got["c", "x"].exact and not got["tied", "x"].exact and not got["a", "y"].exact
    assert got["c", "x"].p_value is not None and got["tied", "x"].p_value == pytest.approx(1.0)
    assert (got["e", "x"].statistic, got["e", "x"].p_value, got["e", "x"].balanced) == (None, None, None)
    assert (got["tied", "y"].n_treatment, got["tied", "y"].n_control, got["tied", "y"].statistic) == (0, 0, None)


def test_sample_ratio(spark):
    rows = [(k, "a", "Treatment" if k < 300 else "Control") for k in range(500)]
    rows += [(k, "b", "Treatment" if k % 2 else "Control") for k in range(500, 700)]
    df = spark.createDataFrame(rows, "client_id bigint, segment string, group string")
    got = {r.segment: r for r in experiment.check_sample_ratio(df).collect()}
    assert got["a"].chi2 == pytest.approx(20.0) and got["a"].srm_detected
    assert got["b"].chi2 == 0 and got["b"].p_value == 1 and not got["b"].srm_detected
    assert (got["all"].n_treatment, got["all"].n_control) == (400, 300)


def test_experiment_result(spark):
    rows = [("Treatment", float(k < 30)) for k in range(100)] + [("Control", float(k < 20)) for k in range(100)]
    df = spark.createDataFrame(rows, "group string, converted double")
    r = experiment.evaluate(df, "converted").collect()[0]
    assert r.status == "measured" and r.lift_pct == pytest.approx(50.0) and r.diff == pytest.approx(0.1)
    se = math.sqrt((0.21 + 0.16) / 99)
    assert r.ci_low == pytest.approx(0.1 - 1.959963984540054 * se)
    assert r.p_value == pytest.approx(tails.student_two_sided(0.1 / se, (0.37**2 / (0.21**2 + 0.16**2)) * 99))


def test_unmeasured(spark):
    assert experiment.evaluate(None, "x", spark=spark).collect()[0].status == "unmeasured"
    df = spark.createDataFrame([("Treatment", 1.0)], "group string, x double")
    assert "y" in experiment.evaluate(df, "y").collect()[0].note
    r = experiment.evaluate(df, "x").collect()[0]
    assert r.status == "unmeasured" and r.mean_treatment is None and r.note
    zero = spark.createDataFrame([("Treatment", 1.0), ("Treatment", 0.0), ("Control", 0.0), ("Control", 0.0)], "group string, x double")
    r = experiment.evaluate(zero, "x").collect()[0]
    assert r.status == "measured" and r.lift_pct is None and r.diff == 0.5


def test_tails():
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert tails.student_two_sided(0.5, 3) == pytest.approx(0.651448, abs=1e-6)
    assert tails.student_two_sided(1.96, 1e6) == pytest.approx(tails.normal_two_sided(1.96), abs=1e-5)
    assert tails.student_two_sided(0.0, 5) == 1.0
    assert tails.chi2_one_df(6.634896601021213) == pytest.approx(0.01)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
