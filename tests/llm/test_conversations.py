import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, lattice
from tidemark.llm.queries import op13_edit_lattice

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def least(turns):
    """(cost, audit, output) by plain recursion; turns are (initial or None if it must go, truncated)."""

    @lru_cache(maxsize=None)
    def best(n, state, inserted):
        ways = [(0, "", ())] if n == len(turns) and state in ("", "a") else []
        if inserted < 2:
            for c in "ua":
                if (state, c) in STEP and (rest := best(n, c, inserted + 1)):
                    ways.append((rest[0] + 2, "I" + rest[1], (c, *rest[2])))
        if n < len(turns):
            initial, cut = turns[n]
            if rest := best(n + 1, state, 0):
                ways.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if initial is not None:
                for c in "ua":
                    if (state, c) in STEP and (rest := best(n + 1, c, 0)):
                        ways.append((rest[0] + 2 + cut, "R" + rest[1], (c, *rest[2])))
                if (state, initial) in STEP and (rest := best(n + 1, initial, 0)):
                    ways.append((rest[0] + cut, "K" + rest[1], (initial, *rest[2])))
        return min(ways, default=None)

    for n in range(len(turns), 0, -1):  # from the end, so that no call goes deep
        for state in ("", *"sua"):
            best(n, state, 0)
    return best(0, "", 0)


def brute(rows):
    """Verdicts of a conversation's rows (turn, role, text) as they stand after damage."""
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
    seen, counts, turns = set(), [0, 0, 0], []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        turns.append((None if fault in (0, 1) else role[:1], int(fault == 2)))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit, _ = least(tuple(turns))
    out, last, it = [], "", iter(rows)
    for edit in audit:
        role, text = next(it)[1:] if edit != "I" else (None, "")
        if edit == "D":
            continue
        role = role if edit == "K" else "assistant" if last == "u" else "user"
        last = role[0]
        out.append(f"{role}:{text}")
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damage(rows):
    told = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = told(role), told(text)
        lot = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        kept += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in rows}


def test_every_short_conversation():
    kinds = [(i, t) for i in ("s", "u", "a", "x") for t in (0, 1)] + [(None, 0)]
    for n in range(5):
        for turns in product(range(9), repeat=n):
            assert lattice.cheapest(bytes(turns), 0, lattice.FINAL) == least(tuple(kinds[t] for t in turns))[:2], turns


def test_parts_join_to_the_whole():
    rng = random.Random(3)
    for size in (1, 2, 7, 30, 90):
        for _ in range(20):
            turns = bytes(rng.choice((0, 2, 2, 4, 4, 3, 5, 6, 8)) for _ in range(size))
            whole = lattice.cheapest(turns, 0, lattice.FINAL)
            ways = {0: (0, "")}
            at = 0
            while at < size:
                step = rng.randint(1, 12)
                ways, at = lattice.joined(ways, lattice.crossings(turns[at : at + step])), at + step
            assert min(ways[s] for s in lattice.FINAL if s in ways) == whole


def random_rows(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.choice((1, 2, 3, 5, 9, 40))):
            turn = rng.choice((turn, turn, turn, turn, None, turn + 2))
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "User"))
            text = rng.choice(("Hello.", "Yes", "no!  \n", "", " \t", None, "Why?", f"t{rng.random()}.", f"t{rng.random()}"))
            rows.append((conv if conv % 50 else None, turn, role, text))
    return rows


@pytest.mark.parametrize("part", [2, 1024])
def test_random_conversations(spark, part):
    rows = random_rows(random.Random(part), 220)
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(tuple(row))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("code", F.lit("clash")).withColumn("no", F.lit(1))
    assert found(conversations.verdicts(df, part=part)) == {c: brute(r) for c, r in by_conv.items()}


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(7, n, rng.choice(("user", "assistant")), f"{n} {'.' if n % 9 else ''}") for n in range(1500)]
    rows += [(7, 4, "user", "again.")] * 700 + [(8, 1, "user", "Hm."), (8, 2, "assistant", "Ha.")]
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(conversations.verdicts(spark.createDataFrame(rows, SCHEMA).repartition(4), part=64))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {c: brute([r[1:] for r in rows if r[0] == c]) for c in (7, 8)}


def test_query_with_odd_rows(spark, tmp_path):
    rows = random_rows(random.Random(1), 150) + [(1000 + n, None, None, None) for n in range(40)]
    rows += [(2000, n, "user", "x" * 300_000) for n in range(3)] + rows[:60]
    spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(0)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = found(op13_edit_lattice(spark, str(tmp_path)))
    assert got == {c: brute(r) for c, r in damage(rows).items()}


def test_query_on_the_test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_edit_lattice(spark, sf_dir)) == {c: brute(r) for c, r in damage(rows).items()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_edit_lattice(spark, str(tmp_path)).collect() == []
    assert conversations.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes."), (1, 2, "user", "Yes."), (2, 0, "user", " "), (3, 5, "system", "Do!")]
    turns = conversations.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    digests = found(conversations.verdicts(spark.createDataFrame(rows, SCHEMA)))
    for conv in (1, 2, 3):
        mine = [t for t in turns if t.conv_id == conv]
        assert [t.place for t in mine] == list(range(len(mine)))
        assert "".join(t.edit for t in mine) == digests[conv][6].replace("D", "")
        said = "\n".join(f"{t.role}:{t.text}" for t in mine)
        assert hashlib.sha256(said.encode()).hexdigest() == digests[conv][7]
    assert not [t for t in turns if t.conv_id == 2]
