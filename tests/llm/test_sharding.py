"""The hash tree against a second implementation, and its movement under changed weights."""

import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash

from tidemark.llm import queries, sharding

PLACED = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", "region", "rack"]


def draw(key, path, weight):
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    unit = ((xxhash.xxh64_intdigest(path.encode(), seed=seed) >> 11) + 0.5) / (1 << 53)
    return -math.log(unit) / weight, path


def descend(key, tree):
    children, at = tree.children(), ""
    while at in children:
        at = min(draw(key, p, w) for p, w in children[at].items())[1]
    return int(at.rsplit("/", 1)[1])


def shards(spark, tree, n=4000):
    keys = spark.range(n).select("id", sharding.shard_number(sharding.F.col("id"), tree).alias("shard"))
    return {r.id: r.shard for r in keys.collect()}


def test_placement_equals_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").collect()
    rows = queries.op1_hash_tree(spark, sf_dir).collect()
    want = {}
    for d in docs:
        raw = (d.text or "").encode()
        want[d.doc_id] = (len(raw) + 8, zlib.crc32(raw), descend(d.doc_id, queries.TREE), descend(d.doc_id, queries.GROWN))
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows} == want
    assert {r.law for r in rows} == {"key"}
    for shard in range(24):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before, after = shards(spark, queries.TREE), shards(spark, queries.GROWN)
    again = shards(spark, queries.GROWN.grown("region0", "rack9"))
    moved = [k for k in before if before[k] != after[k]]
    assert moved and {after[k] for k in moved} == {24}
    assert {again[k] for k in after if again[k] != after[k]} == {25}
    counts = Counter(before.values())
    assert set(counts) == set(range(24)) and max(counts.values()) < 2 * min(counts.values())


def test_changed_weights_move_rows_only_in_changed_subtrees(spark):
    tree = queries.TREE
    before, after = shards(spark, tree), shards(spark, tree.weighted({5: 3.0}))
    place = {s.shard: (s.region, s.rack) for s in tree.shards}
    for k in before:
        if before[k] != after[k]:
            a, b = place[before[k]], place[after[k]]
            # into the region, within it into the rack, within that into the shard
            assert b[0] == place[5][0]
            assert a[0] != b[0] or b == place[5]
            assert a != b or after[k] == 5
    assert 5 not in shards(spark, tree.weighted({5: 0.0})).values()
    with pytest.raises(ValueError):
        tree.weighted({n: 0.0 for n in range(24)}).children()


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (2, "x" * 100_000), (3, "é")]
    docs = spark.createDataFrame([(i, t, 7, "p") for i, t in rows], "doc_id long, text string, shard int, region string")
    got = sharding.placement(docs, queries.TREE, queries.GROWN).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 8) for i, t in rows)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assigned = sharding.assign(docs, queries.TREE)
    assert Counter(assigned.columns) == Counter(["doc_id", "text", "shard", "region", "rack"])
    assert all(r.region.startswith("region") and r.shard < 24 for r in assigned.collect())
    assert sharding.placement(docs.limit(0), queries.TREE, queries.GROWN).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.range(500).withColumnRenamed("id", "doc_id").withColumn("text", sharding.F.lit("t"))
    sharding.write_shards(docs, queries.TREE, f"{tmp_path}/out", files_per_shard=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 500
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(k, v) for k, v in shards(spark, queries.TREE, 500).items()}
