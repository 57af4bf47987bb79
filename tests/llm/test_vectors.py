"""Near-duplicate vectors against all pairs in numpy."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, node string, component_id int"


def plain(rows, cosine=vectors.COSINE):
    good = [
        n for n, (_, v) in enumerate(rows)
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    group = list(range(len(rows)))

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    links = Counter()
    unit = {}
    for n in good:
        x = np.asarray(rows[n][1], np.float32).astype(np.float64)
        x /= np.abs(x).max()
        unit[n] = x / np.sqrt((x * x).sum())
    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= cosine:
                links[a] += 1
                links[b] += 1
                group[top(a)] = top(b)
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        ids[top(n)].append(i)
    out = []
    for n, (i, _) in enumerate(rows):
        least = min((k for k in ids[top(n)] if k is not None), default=None)
        out.append((i, links[n], least, i is not None and i == least))
    return Counter(out)


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)
    return Counter(tuple(r)[:4] for r in vectors.linked(df, **options).collect())


def around(rng, centre, n, noise):
    return [centre + noise * rng.standard_normal(len(centre)) for _ in range(n)]


@pytest.mark.parametrize("large", [vectors.LARGE, 20])
def test_groups_among_random_vectors(spark, large):
    rng = np.random.default_rng(3)
    found = list(rng.standard_normal((150, 24)))
    for n, noise in ((60, 0.05), (25, 0.2), (40, 0.25), (3, 0.1), (2, 0.01)):
        found += around(rng, rng.standard_normal(24), n, noise)
    path = rng.standard_normal(24)
    for _ in range(30):  # a chain: neighbours link, its ends do not
        path = path + 0.25 * rng.standard_normal(24)
        found.append(path.copy())
    found += [found[5], found[160], found[160] * 3]
    order = rng.permutation(len(found))
    rows = [(int(n) * 2, found[n]) for n in order]
    assert result(spark, rows, large=large) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (7, [1.0, 0.0]),
        (None, [5.0, 5.0]), (None, [5.0, 5.0]), (None, None), (12, [1e-30, 0.0]), (13, [3e38, 1.0]), (0, [-1.0, 0.0]),
    ]
    assert result(spark, rows) == plain(rows)
    assert result(spark, []) == Counter()
    assert result(spark, [(1, None)]) == Counter({(1, 0, 1, True): 1})


def test_a_third_of_all_rows_in_one_group(spark):
    rng = np.random.default_rng(4)
    found = list(rng.standard_normal((120, 16))) + around(rng, rng.standard_normal(16), 60, 0.03) + [rng.standard_normal(16)] * 60
    rows = list(enumerate(found))
    assert result(spark, rows, large=32) == plain(rows)


def test_tables_grow_with_the_data():
    small, big = vectors.plan(10_000), vectors.plan(10_000_000)
    assert small[0] < big[0] and small[1] < big[1]
    for bits, tables in (small, big):
        same = (1 - np.arccos(vectors.COSINE) / np.pi) ** bits
        assert (1 - same) ** tables <= vectors.MISS


def loose_cloud(rng, n, pairs):
    """Vectors at cosine 0.85 of each other, in which close pairs are far apart in any one projection."""
    centre = rng.standard_normal(64)
    x = centre / np.linalg.norm(centre) * np.sqrt(0.85) + rng.standard_normal((n, 64)) * np.sqrt(0.15 / 64)
    x[1::2][:pairs] = x[::2][:pairs] + rng.standard_normal((pairs, 64)) * np.sqrt(0.085 / 64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_cell_pairs_the_closest_and_parts_do_not_meet(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([around(rng, c, 40, 0.02) for c in rng.standard_normal((5, 128))] + [rng.standard_normal((200, 128))])
    packed = np.packbits(vectors._signs(x, vectors.SKETCH, 1), axis=1)
    cell = spark.createDataFrame([(5, n, s.tobytes()) for n, s in enumerate(packed)], "cell long, node long, sketch binary")
    pairs = vectors._compared(cell, 400, 0.805).collect()
    top = list(range(400))
    for p in sorted(pairs):
        assert p.a < p.b and p.a // 40 == p.b // 40 < 5
        old, new = top[p.b], top[p.a]
        top = [new if t == old else t for t in top]
    assert len(set(top)) == 205  # every dense group is tied together
    assert len(pairs) <= 200 * (vectors.NEXT + 1)
    parts = {(p.a, p.b) for p in vectors._compared(cell, 400, 0.805, 100).collect()}
    of = {r.node: r.part for r in cell.select("node", F.expr("pmod(xxhash64(node, cell), 8)").alias("part")).collect()}
    assert parts and all(of[a] == of[b] for a, b in parts)


def test_links_in_a_loose_cloud(spark):
    rng = np.random.default_rng(7)
    x = loose_cloud(rng, 1500, 100)
    rows = [(n, v) for n, v in enumerate(np.concatenate([x, rng.standard_normal((1500, 64))]))]
    want = plain(rows)
    df = spark.createDataFrame([(i, [float(c) for c in v], "x", 1) for i, v in rows], SCHEMA)
    for large in (vectors.LARGE, 300):  # below, cells are dealt to parts, and links come from the descent
        out = vectors.linked(df, large=large).collect()
        assert Counter(tuple(r)[:4] for r in out) == want
        assert out[0].recall == 1.0 and out[0].first_recall >= 0.9


def edges_of(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), float(c)) for a, b, c in rows], "a long, b long, cos double")


def test_descent_compares_those_whose_lists_a_node_is_on(spark):
    """Two nodes far down a hub's order, found only as both hold the hub on their lists."""
    rng = np.random.default_rng(9)
    hub = np.zeros(64)
    hub[0] = 1
    x = [hub]
    for n in range(20):  # close to the hub, not to each other
        x.append(np.sqrt(0.83) * hub + np.sqrt(0.17) * np.eye(64)[1 + n])
    far = np.sqrt(0.81) * hub + np.sqrt(0.19) * np.eye(64)[40]
    x += [far, far + 0.05 * np.eye(64)[41]]
    x = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "node long, unit array<double>")
    start = edges_of(spark, [(0, n, x[0] @ x[n]) for n in range(1, 23)])
    for reverse in (64, 5):
        edges, joined = vectors.descend(start, nodes, vectors.COSINE, 0.805)
        assert {(r.node, r.component) for r in joined.collect()} == {(22, 21)}
        parts = vectors._around(vectors._neighbour_lists(start, joined), 1, reverse).groupBy("a", "part").count().collect()
        assert max(r["count"] for r in parts) <= 1 + vectors.NEIGHBOURS + 2.5 * reverse


def test_descent_goes_on_while_lists_change(spark):
    """A walk along a path of vectors that link with nothing, to a link at its end."""
    step = 0.45
    points = [np.array([np.cos(step * n), np.sin(step * n)]) for n in range(7)]
    points.append(np.array([np.cos(step * 6 + 0.2), np.sin(step * 6 + 0.2)]))
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(points)], "node long, unit array<double>")
    # the last node's only neighbour is two steps away from the one it links with
    start = edges_of(spark, [(n, n + 1, np.cos(step)) for n in range(6)] + [(4, 7, np.cos(2 * step + 0.2))])
    edges, joined = vectors.descend(start, nodes, vectors.COSINE, 0.4)
    assert {(r.node, r.component) for r in joined.collect()} == {(7, 6)}


def test_lists_full_of_links_grow_with_their_component(spark):
    """A dense group in two parts that one link joins: its lists get more places, others none."""
    rng = np.random.default_rng(2)
    dense, other = rng.standard_normal(32), rng.standard_normal(32)
    x = np.array(around(rng, dense, 40, 0.02) + around(rng, other, 40, 0.02))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ring = [(n, (n + d) % 20, m) for n in range(20) for d in range(1, 6) for m in (0, 20, 40)]
    edges = edges_of(spark, [(a + m, b + m, x[a + m] @ x[b + m]) for a, b, m in ring])
    apart = spark.createDataFrame([(n, n // 20 * 20) for n in range(60) if n % 20], "node long, component long")
    joined = spark.createDataFrame([(n, n // 40 * 40) for n in range(60) if n % 40], "node long, component long")
    lists = vectors._neighbour_lists(edges, joined)
    room = {r.a: r.room for r in vectors._enlarged(lists, joined, apart, vectors.COSINE).collect()}
    assert room == {n: 16 if n < 40 else 8 for n in range(60)}


def test_audit_asks_a_fixed_number_and_measures(spark):
    assert vectors.ASKED == 3000
    angles = [0, 0.1, 0.2, 1.5, 1.6, 3.0]
    nodes = spark.createDataFrame([(n, [float(np.cos(t)), float(np.sin(t))]) for n, t in enumerate(angles)], "node long, unit array<double>")
    # three links are within the one known component, the fourth is missed
    joined = spark.createDataFrame([(1, 0), (2, 0)], "node long, component long")
    missed, asked, recall = vectors.audit(nodes, joined, vectors.COSINE)
    assert {(r.a, r.b) for r in missed.collect()} == {(3, 4), (4, 3)} and asked == 6 and recall == 6 / 8
    out = vectors.linked(nodes.select(F.col("node").alias("vec_id"), F.col("unit").alias("embedding"))).collect()
    assert vectors.audit(nodes, joined, vectors.COSINE, most=2)[1] == 2
    assert {(r.asked, r.recall, r.recall_low, r.turns) for r in out} == {(6, 1.0, 1.0, 1)}
