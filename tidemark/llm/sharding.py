"""Weighted hash tree: a row descends region, rack and shard by weighted hash draws.

At every node each child draws ``-ln(u) / weight`` from a hash of the key and the child's
path, and the smallest draw wins, so a child gets its share of the keys by weight. A
child's draws depend on its own path and weight alone: when weights change, keys move only
into children whose weight rose or out of children whose weight fell, and below an
unchanged node nothing moves. An added shard draws at the top with its own weight under a
path of its own and is labelled with the region and rack it stands in; so it takes keys
into itself and causes no other movement, whatever the shape of the tree.

Null keys are hashed as a missing value: all rows without a key share one shard. Equal
keys share a shard. The key and the tree decide; texts and their copies play no part.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0
    added: bool = False


@dataclass(frozen=True)
class Tree:
    """Shards with the places they stand in."""

    shards: tuple[Shard, ...]

    @staticmethod
    def even(regions: int, racks: int, per_rack: int) -> Tree:
        """Equal shards numbered through regions, and racks within them."""
        place = [(r, k) for r in range(regions) for k in range(racks) for _ in range(per_rack)]
        return Tree(tuple(Shard(n, f"region{r}", f"rack{k}") for n, (r, k) in enumerate(place)))

    def grown(self, region: str, rack: str, weight: float = 1.0) -> Tree:
        """With one more shard."""
        number = max((s.shard for s in self.shards), default=-1) + 1
        return Tree((*self.shards, Shard(number, region, rack, weight, added=True)))

    def weighted(self, weights: dict[int, float]) -> Tree:
        """With other weights for some shards; 0 empties a shard."""
        return Tree(tuple(replace(s, weight=weights.get(s.shard, s.weight)) for s in self.shards))

    def path(self, shard: Shard) -> tuple[str, str, str]:
        top = f"+{shard.shard}" if shard.added else shard.region
        return top, f"{top}/{shard.rack}", f"{top}/{shard.rack}/{shard.shard}"

    def children(self) -> dict[str, dict[str, float]]:
        """Paths and weights of the children of every node; the root is the empty path."""
        out: dict[str, dict[str, float]] = {}
        for s in self.shards:
            if s.weight < 0:
                raise ValueError(f"shard {s.shard} has a negative weight")
            if s.weight:
                for above, node in zip(("", *self.path(s)), self.path(s)):
                    below = out.setdefault(above, {})
                    below[node] = below.get(node, 0.0) + s.weight
        if not out:
            raise ValueError("the tree has no shard with a weight")
        return out


def _winner(key: Column, node: Column, children: Column) -> Column:
    """Path of the child that draws least."""
    unit = lambda path: (F.shiftrightunsigned(F.xxhash64(key, path), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    draw = lambda c: F.struct((-F.log(unit(c["node"])) / c["weight"]).alias("draw"), c["node"].alias("node"))
    return F.array_min(F.transform(F.element_at(children, node), draw))["node"]


def shard_path(key: Column, tree: Tree) -> Column:
    """Path of the shard a key belongs to."""
    pairs = []
    for node, below in tree.children().items():
        pairs.append(F.lit(node))
        pairs.append(F.array(*(F.struct(F.lit(p).alias("node"), F.lit(w).alias("weight")) for p, w in below.items())))
    children = F.create_map(*pairs)
    at = F.lit("")
    for _ in range(3):
        at = _winner(key, at, children)
    return at


def shard_number(key: Column, tree: Tree) -> Column:
    return F.substring_index(shard_path(key, tree), "/", -1).cast("int")


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """Adds ``region``, ``rack`` and ``shard``; columns of these names are replaced."""
    places = [F.lit(x) for s in tree.shards for x in (s.shard, F.struct(F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack")))]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("region", "rack", "shard")]
    placed = docs.select(*kept, shard_number(F.col(f"`{key}`"), tree).alias("shard"))
    place = F.element_at(F.create_map(*places), F.col("shard"))
    return placed.withColumns({"region": place["region"], "rack": place["rack"]})


def write_shards(docs: DataFrame, tree: Tree, path: str, files_per_shard: int, key: str = "doc_id") -> None:
    """Parquet folders ``shard=n``; a shard's rows are spread over its files by row content."""
    rows = assign(docs, tree, key)
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(files_per_shard))
    parts = len(tree.shards) * files_per_shard
    rows.repartition(parts, "shard", spread).write.partitionBy("shard").parquet(path)


def slots(rows: DataFrame, shard: str = "shard", blocks: int = 256) -> DataFrame:
    """Adds ``slot``, counted from 0 without gaps in every shard.

    Equal rows are counted before the shuffle and numbered together. A shard's different
    rows are dealt to ``blocks`` by their content; only the blocks' sums, ``blocks`` rows
    a shard, are added up in one place. ``rows`` is read twice and is best written out.
    """
    own = [F.col(f"`{c}`") for c in rows.columns if c != "slot"]
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_block", F.pmod(F.xxhash64(*own), F.lit(blocks)))
    sums = rows.groupBy(F.col(f"`{shard}`"), F.pmod(F.xxhash64(*own), F.lit(blocks)).alias("_block"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.agg(F.count(F.lit(1)).alias("_n")).select(
        shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(shard, "_block").orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    first = F.col("_start") + F.col("_first")
    # blocks x shards rows: bounded by the parameters, not by the data
    return numbered.join(F.broadcast(starts), [shard, "_block"]).select(
        *own, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot")
    )


def placement(docs: DataFrame, tree: Tree, grown: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, CRC-32 of the text, place, slot, and the shard under the grown tree.

    One row per row of ``docs``, repeated ones too; null texts have size 8 and CRC-32 0.
    """
    raw = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    rows = assign(
        docs.select(
            F.col(f"`{key}`"),
            (F.octet_length(raw) + 8).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
        ),
        tree,
        key,
    )
    rows = rows.withColumn("grown_shard", shard_number(F.col(f"`{key}`"), grown))
    return slots(materialize(rows))
