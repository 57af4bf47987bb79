"""Exact duplicates against grouping in plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import exactdup


def norm(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ROWS = [
    (1, "Abc", "en"), (2, "aBC", "en"), (3, "É", "fr"), (4, "é", "fr"), (5, None, None), (6, "", "de"), (7, "x", "a"),
    (7, "X", "b"), (8, "r", "s"), (8, "r", "s"), (8, "r", "s"), (None, "n", "n"), (None, "N", "n"), (None, "abc", "q"),
    (9, "long " * 50_000, "en"), (10, "LONG " * 50_000, "en"),
]
SCHEMA = "doc_id long, text string, digest string"


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    got = exactdup.verdicts(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    kept = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.digest)
        ids = [g[0] for g in groups[text]]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert kept == Counter(list(groups))
    out = exactdup.deduplicated(docs)
    assert out.columns == docs.columns
    stay = [tuple(r) for r in out.collect()]
    assert Counter(norm(t) for _, t, _ in stay) == Counter(list(groups)) and set(stay) <= set(rows)
    for i, t, _ in stay:
        assert i == max((g[0] for g in groups[norm(t)] if g[0] is not None), default=None)


def test_odd_rows(spark):
    check(spark, ROWS)


def test_a_group_with_a_third_of_all_rows(spark):
    check(spark, ROWS + [(100 + n, "Copy" if n % 2 else "copy", "en") for n in range(400)] + [(1000, "same", "x")] * 300)


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exactdup.verdicts(docs).collect() == [] and exactdup.deduplicated(docs).collect() == []


def test_the_index_lasts(spark, tmp_path):
    path = f"{tmp_path}/index"
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = exactdup.deduplicated(frame([(1, "a", ""), (2, "A", ""), (3, "b", "")]), path=path)
    assert {r.doc_id for r in first.collect()} == {2, 3}
    again = exactdup.verdicts(frame([(9, "a", ""), (8, "c", ""), (7, "C", "")]), path=path).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(9, 2, False), (8, 8, True), (7, 8, False)}
    entries = exactdup.DigestIndex(spark, path).entries()
    assert entries.count() == 3 == entries.select("digest").distinct().count()


@pytest.mark.parametrize("column", ["keep_id", "kept", "id", "row_hash"])
def test_clashing_names(spark, column):
    docs = spark.createDataFrame([(1, "a", "q"), (2, "a", "w")], f"doc_id long, text string, {column} string")
    assert [tuple(r) for r in exactdup.deduplicated(docs).collect()] == [(2, "a", "w")]
    assert {r.kept for r in exactdup.verdicts(docs).collect()} == {True, False}
