"""Near-duplicate vectors by NN-descent over lists of close neighbours.

1. Vectors equal in every component (by a 128-bit digest) form a class; one row stands for it.
2. First lists: random hyperplanes cut the space into cells of about ``CELL`` nodes, a few
   times. Into a cell go numbers of nodes and sketches, ``SKETCH`` signs of further
   hyperplanes, and no vectors. A node is paired with the ``NEXT`` closest by sketch and with
   the first that is close, which ties a dense cell together. A cell with more than ``large``
   nodes is dealt to parts at random, another way in each table. These pairs are measured on
   the vectors and are where the descent starts from: a pair at the threshold shares no cell
   in one of ``1 / MISS`` cases.
3. Rounds: a node has two lists of its closest neighbours up to twice the link's angle,
   beyond which no neighbour of a linked neighbour can lie: one from its own component and
   one from the others, so that a dense group does not hide a link out of it. A node's
   lists are compared with each other and with those whose lists it is on; where these are
   more than ``REVERSE``, they are dealt to parts, anew each round, and every part meets the
   lists. Only pairs of which one is new around the node are compared. What betters a list
   or links two components goes on. A list starts with ``NEIGHBOURS`` places; one that is
   full of links while its component still grows gets twice as many. The descent ends when
   at most ``CHANGED`` of the list entries are new and no components join.
4. Audit: ``ASKED`` nodes, or all, are compared with all nodes; other nodes each time. It
   gives the recall: the share of the asked nodes' links that lie within components. A link
   that joins two components is added, and the search repeats with new hyperplanes. The
   search ends with an audit that misses nothing; with so many asked, ``RECALL`` of the nodes
   then miss no link (95 % confidence, whatever their number), and all of them where all
   were asked. The asked vectors go through the driver; their number is the bound.
5. Links: all links of a node are within its component, so they are counted there, exactly
   and in double precision. A component of more than ``LARGE`` nodes is not gathered:
   members within half the link's angle of its mean direction are linked to each other
   by the triangle inequality and only counted, and the others are compared block by block
   with all members.

Vectors that are null, zero or hold null or non-finite components link with nothing; so do
vectors of different length. Copies count as links of each other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize

from .components import components

COSINE = 0.95
#: Chance that a pair at the threshold shares no cell, and the least number of tables.
MISS, TABLES = 0.1, 4
#: Members a cell has on average, and how many of the closest in its cell a node is paired with.
CELL, NEXT = 32, 8
#: Signs of a sketch. Angles told from it are off by ``SIGMAS`` standard deviations at most.
SKETCH, SIGMAS = 256, 4
#: Length of a neighbour list at first.
NEIGHBOURS = 8
#: Those whose lists a node is on are compared in parts of about so many.
REVERSE = 64
#: Share of new list entries at which the descent ends.
CHANGED = 0.001
#: Share of nodes without a missed link that a clean audit vouches for.
RECALL = 0.999
#: So many nodes are asked: that none missed a link proves ``RECALL`` (rule of three).
ASKED = math.ceil(3 / (1 - RECALL) - 1e-6)
#: Nodes of a component, or rows of a block, that are compared in one task.
LARGE = 4096
#: Rows that are handed to one call of the comparison of cells, about.
CALL = 16_384


def plan(nodes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Hyperplanes per table and number of tables for so many nodes."""
    bits = min(60, max(0, math.ceil(math.log2(max(1, nodes / CELL)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(TABLES, math.ceil(math.log(miss) / math.log(1 - same))) if bits else 1


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def _by_length(lists: pa.Array):
    """Each length of the lists, the rows that have it, and these as a matrix."""
    lengths = lists.value_lengths().to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, _matrix(lists.take(pa.array(rows)), int(length))


def _signs(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """On which side of ``bits`` random hyperplanes each row is."""
    return x @ np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits)) > 0


def classes(vectors: DataFrame, embedding: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, id, digest or null), and classes (node, digest, size, least_id, unit)."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    # minus zero equals zero, but not in a digest
    clean = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    kind = vectors.schema[key].dataType.simpleString()

    def unit(batches):
        for batch in batches:
            vector = batch.column("vector")
            digests, units = [None] * len(vector), [None] * len(vector)
            there = np.flatnonzero(vector.is_valid().to_numpy(zero_copy_only=False))
            for _, rows, x in _by_length(vector.take(pa.array(there))):
                for n, raw, one in zip(there[rows], np.ascontiguousarray(x), _unit(x)):
                    digests[n], units[n] = hashlib.blake2b(raw.tobytes(), digest_size=16).digest(), one
            columns = [batch.column("row_id"), batch.column("id"), pa.array(digests, pa.binary()), pa.array(units, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "id", "digest", "unit"])

    source = vectors.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(f"`{key}`").alias("id"),
        F.when(v.isNotNull() & ~bad & some, clean).alias("vector"),
    )
    rows = materialize(source.mapInArrow(unit, f"row_id long, id {kind}, digest binary, unit array<double>"))
    found = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("row_id").alias("node"), F.count(F.lit(1)).alias("size"), F.min("id").alias("least_id")
    )
    units = rows.filter(F.col("digest").isNotNull()).select(F.col("row_id").alias("node"), "unit")
    return rows.select("row_id", "id", "digest"), materialize(found.join(units, "node"))


def _beyond(cosine: float) -> float:
    """Share of signs up to which sketches of vectors of that cosine or more may differ."""
    share = math.acos(cosine) / math.pi
    return share + SIGMAS * math.sqrt(share * (1 - share) / SKETCH)


def _closest(sketches: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows: each with the ``NEXT`` closest by sketch and with the first that is close."""
    signs, out = np.unpackbits(sketches, axis=1).astype(np.float32) * 2 - 1, []
    for at in range(0, len(signs), 1024):
        apart = (1 - signs[at : at + 1024] @ signs.T / SKETCH) / 2
        own = np.arange(len(apart))
        apart[own, at + own] = 2
        near = apart <= most
        i = np.flatnonzero(near.any(axis=1))
        out.append((i + at, near[i].argmax(axis=1)))
        if len(signs) > NEXT + 1:
            j = np.argpartition(apart[i], NEXT, axis=1)[:, :NEXT]
            i = np.repeat(i, NEXT)
            j = j.ravel()
            good = near[i, j]
            out.append((i[good] + at, j[good]))
        else:
            i, j = np.nonzero(near)
            out.append((i + at, j))
    return tuple(np.concatenate(x) for x in zip(*out))


def _compared(dealt: DataFrame, rows: int, floor: float, large: int = LARGE) -> DataFrame:
    """Pairs (a, b) of members (cell, node, sketch) of a cell that are close by sketch.

    Cells above ``large`` are dealt at random to parts of about half that, which do not meet.
    """
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))
    crowded = sizes.filter(F.col("members") > large).select("cell", F.ceil(F.col("members") * 2 / large).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node", "cell"), F.coalesce("parts", F.lit(1))).cast("int")
    calls = max(1, math.ceil(rows / CALL))
    spread = dealt.join(crowded, "cell", "left").select("cell", part.alias("part"), "node", "sketch")
    spread = spread.withColumn("call", F.pmod(F.xxhash64("cell", "part"), F.lit(calls)))
    most = _beyond(floor)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("part", "ascending")]).combine_chunks()
        cell, part, node = (table.column(c).to_numpy() for c in ("cell", "part", "node"))
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1, [len(node)]])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                i, j = _closest(sketches[a:b], most)
                found.append((np.minimum(node[a + i], node[a + j]), np.maximum(node[a + i], node[a + j])))
        a, b = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": a, "b": b})

    return spread.groupBy("call").applyInArrow(run, "a long, b long").distinct()


def measured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) with their cosine in double precision; none of vectors of different length."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            cos = np.empty(len(x))
            for _, rows, left in _by_length(x):
                cos[rows] = (left * _matrix(y.take(pa.array(rows)), left.shape[1])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cos)], names=["a", "b", "cos"])

    end = lambda c, x: nodes.select(F.col("node").alias(c), F.col("unit").alias(x))
    both = pairs.select("a", "b").join(end("a", "x"), "a").join(end("b", "y"), "b").filter(F.size("x") == F.size("y"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cos double")


def first_lists(nodes: DataFrame, count: int, seed: int, cosine: float, floor: float, large: int = LARGE) -> DataFrame:
    """Edges (a, b, cos) of pairs that meet in a cell and are close enough for a list."""
    bits, tables = plan(count, cosine)

    def cells(batches):
        for batch in batches:
            for length, rows, x in _by_length(batch.column("unit")):
                node = batch.column("node").take(pa.array(rows))
                packed = np.packbits(_signs(x, SKETCH, 2 * seed), axis=1)
                sketch = pa.array([s.tobytes() for s in packed], pa.binary())
                sides = _signs(x, bits * tables, 2 * seed + 1)
                for table in range(tables):
                    cell = sides[:, table * bits : (table + 1) * bits] @ (1 << np.arange(bits, dtype=np.int64))
                    cell = (cell * 0x9E3779B1 + table * 0x85EBCA77 + length * 0xC2B2AE3D) % (1 << 62)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), node, sketch], names=["cell", "node", "sketch"])

    dealt = nodes.select("node", "unit").mapInArrow(cells, "cell long, node long, sketch binary")
    return measured(_compared(dealt, count * tables, floor, large), nodes).filter(F.col("cos") >= floor)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "cos").union(edges.select("b", "a", "cos"))


def _once(edges: DataFrame) -> DataFrame:
    """Each pair once, smaller node first."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cos").alias("cos"))


def _neighbour_lists(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """Both lists of every node: a, b, cos, whether b is of another component, a's component, and the list's places."""
    return _ranked(_both_ways(edges).withColumn("room", F.lit(NEIGHBOURS)), joined)


def _ranked(entries: DataFrame, joined: DataFrame) -> DataFrame:
    """The closest of the entries (a, b, cos, room) of every list, as many as it has places."""
    part = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    both = entries.join(part("a"), "a", "left").join(part("b"), "b", "left")
    a, b = F.coalesce("a_part", "a"), F.coalesce("b_part", "b")
    both = both.select("a", "b", "cos", (a != b).alias("out"), a.alias("component"), F.max("room").over(Window.partitionBy("a")).alias("room"))
    best = Window.partitionBy("a", "out").orderBy(F.col("cos").desc(), "b")
    return both.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= F.col("room")).drop("turn")


def _around(lists: DataFrame, seed: int, reverse: int = REVERSE) -> DataFrame:
    """Who is compared around each node: (a, part, b, fresh), its lists in every part of those whose lists it is on."""
    lists = lists if "fresh" in lists.columns else lists.withColumn("fresh", F.lit(True))
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh")
    parts = back.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / reverse).cast("int").alias("parts"))
    # the node itself is on its lists
    own = lists.select("a", "b", "fresh").union(lists.select("a", F.col("a").alias("b"), F.lit(False)).distinct())
    own = own.join(parts, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = own.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "b", "fresh")
    dealt = back.join(parts, "a").select("a", F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.col("parts")).cast("int").alias("part"), "b", "fresh")
    return own.union(dealt).groupBy("a", "part", "b").agg(F.max("fresh").alias("fresh"))


def _bars(lists: DataFrame) -> DataFrame:
    """Per node (a): its component, and what a pair has to exceed to enter a list, nothing while that is not full."""
    worst = lambda out: F.when(F.sum((F.col("out") == out).cast("int")) >= F.max("room"), F.min(F.when(F.col("out") == out, F.col("cos"))))
    return lists.groupBy("a").agg(
        F.first("component").alias("component"),
        F.coalesce(worst(False), F.lit(-2.0)).alias("inner"),
        F.coalesce(worst(True), F.lit(-2.0)).alias("outer"),
    )


def _enlarged(lists: DataFrame, joined: DataFrame, before: DataFrame, cosine: float) -> DataFrame:
    """The lists with twice the places for nodes whose list is full of links while their component grows."""
    was = before.select("node", F.col("component").alias("was"))
    grown = joined.join(was, "node", "left").filter(~F.col("was").eqNullSafe(F.col("component"))).select("component").distinct()
    inner = lists.filter("not out").groupBy("a", "component").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least"), F.max("room").alias("room"))
    full = inner.filter((F.col("n") >= F.col("room")) & (F.col("least") >= cosine)).join(grown, "component", "left_semi")
    wider = _fresh(full.select("a", (F.col("room") * 2).alias("wider")))
    return lists.join(wider, "a", "left").withColumn("room", F.coalesce("wider", "room")).drop("wider")


def descend(
    edges: DataFrame, nodes: DataFrame, cosine: float, floor: float, changed: float = CHANGED, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rounds over neighbour lists until they settle; the edges of the lists and the components.

    ``known`` are components (node, component) of earlier searches. Vectors are compared in
    single precision; a cosine too close to the threshold to tell is measured in double.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("part", "ascending")]).combine_chunks()
        of, part, name, component, inner, outer = (
            table.column(c).to_numpy() for c in ("a", "part", "b", "component", "inner", "outer")
        )
        fresh = table.column("fresh").combine_chunks().to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(of) != 0) | (np.diff(part) != 0)) + 1, [len(of)]])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2 or not fresh[a:b].any():
                continue
            size = len(table.column("unit")[int(a)])  # lists hold vectors of one length
            x = _matrix(table.column("unit").slice(a, b - a).combine_chunks(), size)
            cos, margin = (x @ x.T).astype(np.float64), 1e-7 * (size + 8)
            apart = component[a:b, None] != component[None, a:b]
            worst = np.where(apart, outer[a:b, None], inner[a:b, None])
            better = (cos > np.minimum(worst, worst.T)) | (apart & (cos >= cosine - margin))
            better &= fresh[a:b, None] | fresh[None, a:b]
            i, j = np.nonzero(np.triu(better & (cos >= floor), 1))
            close = np.abs(cos[i, j] - cosine) <= margin
            found.append((np.minimum(name[a + i], name[a + j]), np.maximum(name[a + i], name[a + j]), cos[i, j], close))
        return pa.table(dict(zip(("a", "b", "cos", "close"), (np.concatenate(c) for c in zip(*found)))))

    stars = lambda of: of.select(F.col("node").alias("a"), F.col("component").alias("b"))
    links = edges.filter(F.col("cos") >= cosine).select("a", "b")
    joined, turn, bars = components(links if known is None else links.union(stars(known))), 0, None
    lists = materialize(_neighbour_lists(edges, joined).withColumn("fresh", F.lit(True)))
    short = nodes.select(F.col("node").alias("b"), F.col("unit").cast("array<float>").alias("unit"))
    while True:
        turn += 1
        now = _bars(lists).withColumnRenamed("a", "b")
        if bars is not None:
            # what did not better a list of before may better one that has lost entries or got places
            was = bars.select("b", F.col("inner").alias("was_inner"), F.col("outer").alias("was_outer"))
            lower = (F.col("inner") < F.col("was_inner")) | (F.col("outer") < F.col("was_outer"))
            now = now.join(was, "b", "left").withColumn("lower", F.coalesce(lower, F.lit(True))).drop("was_inner", "was_outer")
        bars = materialize(now if bars is not None else now.withColumn("lower", F.lit(True)))
        around = _around(lists, turn).join(_fresh(bars), "b").withColumn("fresh", F.col("fresh") | F.col("lower")).drop("lower")
        around = materialize(around)
        active = around.groupBy("a", "part").agg(F.max("fresh").alias("any")).filter("any").select("a", "part")
        calls = max(1, math.ceil(around.count() / CALL))
        met = _fresh(around).join(active, ["a", "part"], "left_semi").join(short, "b").withColumn("call", F.pmod(F.xxhash64("a", "part"), F.lit(calls)))
        met = met.groupBy("call").applyInArrow(run, "a long, b long, cos double, close boolean")
        met = materialize(met.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.max("close").alias("close")))
        new = met.filter("not close").select("a", "b", "cos").union(measured(met.filter("close"), nodes))
        new = materialize(new.join(_once(lists).select("a", "b"), ["a", "b"], "left_anti"))
        part = lambda c: _fresh(joined).select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))  # noqa: B023, E731
        links = new.filter(F.col("cos") >= cosine).join(part("a"), "a", "left").join(part("b"), "b", "left")
        links = links.filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")
        before = joined
        if not links.isEmpty():
            # what is joined is already stars around each component's smallest node
            joined = components(stars(joined).union(links))
        kept = _enlarged(lists, joined, before, cosine).select("a", "b", "cos", "room")
        kept = kept.union(_both_ways(new).select("a", "b", "cos", F.lit(NEIGHBOURS)))
        now = _ranked(kept, joined)
        old = _fresh(lists.select("a", "b", "out")).withColumn("old", F.lit(True))
        now = now.join(old, ["a", "b", "out"], "left").withColumn("fresh", F.col("old").isNull()).drop("old")
        lists = materialize(now)
        entered, entries = lists.agg(F.coalesce(F.sum(F.col("fresh").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
        if entered <= changed * entries and joined is before:
            return _once(lists), joined


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for grouping beside a frame of one origin."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def audit(nodes: DataFrame, joined: DataFrame, cosine: float, turn: int = 0, most: int = ASKED) -> tuple[DataFrame, int, float]:
    """Links (a, b, cos) from the asked nodes to nodes of other components, how many nodes were asked, and the recall.

    ``most`` nodes are asked, those with the smallest hashes in this turn. The recall is the
    share of the asked nodes' links that are within components; null if they have none.
    """
    spark = nodes.sparkSession
    of = nodes.select("node", "unit").join(_fresh(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = materialize(of)
    few = of.orderBy(F.xxhash64("node", F.lit(turn)), "node").limit(most).toArrow().combine_chunks()
    asked = {}
    if len(few):
        for length, rows, x in _by_length(few.column("unit").combine_chunks()):
            asked[length] = (x, few.column("node").to_numpy()[rows], few.column("component").to_numpy()[rows])
    asked = spark.sparkContext.broadcast(asked)

    def look(batches):
        """Missed links, and in a row without nodes how many links are within components."""
        inside, out = 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for batch in batches:
            node, component = batch.column("node").to_numpy(), batch.column("component").to_numpy()
            for length, rows, x in _by_length(batch.column("unit")):
                y, name, part = asked.value.get(length, (np.zeros((0, length)), np.zeros(0, np.int64), np.zeros(0, np.int64)))
                for at in range(0, len(rows), 1024):
                    here = rows[at : at + 1024]
                    cos = y @ x[at : at + 1024].T
                    near = (cos >= cosine) & (name[:, None] != node[here][None, :])
                    apart = near & (part[:, None] != component[here][None, :])
                    inside += int(near.sum()) - int(apart.sum())
                    i, j = np.nonzero(apart)
                    out.append((name[i], node[here][j], cos[i, j]))
            a, b, cos = (np.concatenate(c) for c in zip(*out))
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "cos": cos, "inside": np.zeros(len(a), np.int64)})
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64()), "cos": pa.array([None], pa.float64()), "inside": pa.array([inside], pa.int64())}
        )

    found = materialize(of.mapInArrow(look, "a long, b long, cos double, inside long"))
    missed = found.filter("a is not null").select("a", "b", "cos")
    seen = found.agg(F.coalesce(F.sum("inside"), F.lit(0)), F.count("a")).first()
    return missed, len(few), seen[0] / sum(seen) if sum(seen) else None


def _count_small(members: DataFrame, cosine: float) -> DataFrame:
    """Links of every node of components that fit one task."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        x, weight = np.stack(rows["unit"].to_numpy()), rows["size"].to_numpy()
        links = np.empty(len(x), np.int64)
        for n in range(0, len(x), 1024):
            near = x[n : n + 1024] @ x.T >= cosine
            near[np.arange(len(near)), n + np.arange(len(near))] = True
            links[n : n + 1024] = near @ weight - 1
        return pd.DataFrame({"node": rows["node"], "links": links})

    return members.groupBy("component").applyInPandas(count, "node long, links long")


def _count_large(members: DataFrame, cosine: float, large: int) -> DataFrame:
    """Links of every node of components that do not."""

    def part(batches):
        for rows in batches:
            for component, own in rows.groupby("component"):
                yield pd.DataFrame({"component": [component], "total": [np.stack(own["unit"].to_numpy()).sum(axis=0)]})

    sums = members.mapInPandas(part, "component long, total array<double>")
    place = sums.select("component", F.posexplode("total").alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("x"))
    mean = place.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p"))
    mean = mean.select("component", F.transform("p", lambda p: p["x"]).alias("mean"))
    half = math.cos(math.acos(cosine) / 2) + 1e-9

    def core(x: pd.Series, mean: pd.Series) -> pd.Series:
        m = np.stack(mean.to_numpy())
        m = m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        return pd.Series((np.stack(x.to_numpy()) * m).sum(axis=1) >= half)

    is_core = F.pandas_udf(core, "boolean")
    placed = materialize(members.join(mean, "component").withColumn("core", is_core("unit", "mean")).drop("mean"))
    inner = placed.filter("core").groupBy("component").agg(F.sum("size").alias("inner"))
    own = placed.filter("core").join(inner, "component").select("node", (F.col("inner") - 1).alias("links"))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    number = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col(n) / large)).cast("int")
    outer = placed.filter("not core").join(sizes, "component").withColumn("block", number("members", 1))
    blocks = outer.select("component", "block").distinct()
    right = placed.join(sizes, "component").withColumn("slice", number("members", 2)).join(blocks, "component")
    left = outer.join(right.select("component", "block", "slice").distinct(), ["component", "block"])
    columns = ("component", "block", "slice", "node", "size", "core", "unit")

    def meet(key, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"node": [], "links": []}).astype("int64")
        near = np.stack(l["unit"].to_numpy()) @ np.stack(r["unit"].to_numpy()).T >= cosine
        same = l["node"].to_numpy()[:, None] == r["node"].to_numpy()[None, :]
        weight = near * r["size"].to_numpy()[None, :]
        mine = np.where(same, r["size"].to_numpy()[None, :] - 1, weight).sum(axis=1)
        inside = r["core"].to_numpy()
        back = (near[:, inside] * l["size"].to_numpy()[:, None]).sum(axis=0)
        return pd.DataFrame(
            {"node": np.concatenate([l["node"], r["node"].to_numpy()[inside]]), "links": np.concatenate([mine, back])}
        )

    met = _fresh(left.select(*columns)).groupBy("component", "block", "slice").cogroup(
        right.select(*columns).groupBy("component", "block", "slice")
    ).applyInPandas(meet, "node long, links long")
    return own.union(met).groupBy("node").agg(F.sum("links").alias("links"))


def linked(vectors: DataFrame, embedding: str = "embedding", key: str = "vec_id", cosine: float = COSINE, large: int = LARGE) -> DataFrame:
    """Per row: key, n_links, component_id, kept, and in ``turns`` the searches it took.

    Besides, ``first_recall`` of the first search and ``recall`` of the last as their audits
    measured them (null if no asked node has links), ``asked`` nodes of the last audit, which
    missed nothing, and in ``recall_low`` the share of nodes without a missed link that it
    vouches for. Null keys are no component's id unless no member has a key; their rows are
    not kept.
    """
    rows, nodes = classes(vectors, embedding, key)
    floor = math.cos(min(math.pi / 2, 2 * math.acos(cosine)))
    count, turns, edges, joined = nodes.count(), 0, None, None
    while True:
        found = first_lists(nodes, count, turns, cosine, floor, large)
        edges = materialize(_once(found if edges is None else found.union(edges)))
        edges, joined = descend(edges, nodes, cosine, floor, known=joined)
        missed, asked, recall = audit(nodes, joined, cosine, turns)
        turns += 1
        first = recall if turns == 1 else first
        if missed.isEmpty():
            break
        edges = materialize(_once(edges.union(missed)))
    least = joined.select("component").distinct().withColumn("node", F.col("component"))
    group = joined.select("node", "component").union(least.select("node", "component"))
    members = materialize(nodes.join(group, "node").select("component", "node", "size", "least_id", "unit"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.min("least_id").alias("component_id"))
    wide = members.join(sizes, "component")
    links = _count_small(wide.filter(F.col("members") <= large).drop("members", "component_id", "least_id"), cosine)
    many = wide.filter(F.col("members") > large).drop("members", "component_id", "least_id")
    if not many.isEmpty():
        links = links.union(_count_large(many, cosine, large))
    counted = links.join(members.select("node", "component"), "node").join(sizes.select("component", "component_id"), "component")
    of = nodes.join(counted.select("node", "links", "component_id"), "node", "left").select(
        "node",
        F.coalesce("links", F.col("size") - 1).alias("n_links"),
        F.when(F.col("links").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    named = nodes.select("node", "digest").join(_fresh(of), "node").select("digest", "n_links", "component_id")
    none = rows.filter(F.col("digest").isNull()).select("id", "digest", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))
    out = rows.filter(F.col("digest").isNotNull()).join(named, "digest").select("id", "digest", "n_links", "component_id").union(none)
    own = F.col("component_id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"),
        F.lit(turns).alias("turns"),
        F.lit(first).cast("double").alias("first_recall"),
        F.lit(recall).cast("double").alias("recall"),
        F.lit(asked).cast("long").alias("asked"),
        F.lit(1.0 if asked == count else max(0.0, 1 - 3 / asked) if asked else 0.0).alias("recall_low"),
    )
