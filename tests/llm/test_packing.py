"""Packing against the tokenizers library, its own rules and known bounds."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import bpe, langid, neardup, packing, queries
from tidemark.llm.transducer import load_ranks

PATTERN = public_tokenizers.PATTERN


def library():
    t = Tokenizer.from_file(queries.TOKENIZER)
    t.encode_special_tokens = True
    return t


def check(rows, docs, capacity):
    """Rows are whole, rightly cut and fill their sequences without gap or overlap."""
    t = library()
    want, got = defaultdict(list), defaultdict(list)
    for key, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        n = len(ids)
        cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key].append((piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    used = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        used[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    sizes = np.array([r.length for r in rows], np.int64)
    return len(used), packing.lower_bound(np.bincount(sizes, minlength=capacity + 1)) if len(sizes) else 0


def test_query_on_test_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    used, bound = check(queries.op9_bounded_best_fit(spark, sf_dir).collect(), docs, packing.CAPACITY)
    assert used <= bound + 1


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "<|endoftext|>"), (4, "word " * 5000), (4, "word " * 5000), (None, "no key"), (None, None),
        (5, " a" * 2047), (6, " a" * 2048), (7, " a" * 4095), (8, "é\n\n  x"),
    ]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, length int, offset int")
    used, bound = check(packing.pack(df, queries.TOKENIZER, PATTERN).collect(), docs, 2048)
    assert used == bound
    assert packing.pack(df.limit(0), queries.TOKENIZER, PATTERN).collect() == []


def test_partitions_with_gaps_exchange(spark):
    rng = random.Random(5)
    docs = [(n, " a" * rng.choice([2, 3, 4, 6, 9, 11, 14])) for n in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    alone = packing.pack(df, queries.TOKENIZER, PATTERN, capacity=20, per_partition=10**6).collect()
    many = packing.pack(df, queries.TOKENIZER, PATTERN, capacity=20, per_partition=25).collect()
    one, bound = check(alone, docs, 20)
    parted, _ = check(many, docs, 20)
    first = packing._used(packing._packed(packing.pieces(df, queries.TOKENIZER, PATTERN, capacity=20), 0, 25, 20))
    assert bound <= one <= parted < first and parted <= one + 3


def test_lower_bounds():
    counts = lambda sizes, c: np.bincount(sizes, minlength=c + 1)
    assert packing.lower_bound(counts([6] * 5, 10)) == 5
    assert packing.lower_bound(counts([4] * 7, 10)) == 4  # two of them in a bin
    assert packing.lower_bound(counts([], 10)) == 0 and packing.lower_bound(counts([10, 1], 10)) == 2
    rng = random.Random(6)
    for _ in range(30):
        sizes = sorted(rng.choices(range(1, 31), k=40), reverse=True)
        bins, _, room = packing.best_fit(np.array(sizes), 30)
        assert -(-sum(sizes) // 30) <= packing.lower_bound(counts(sizes, 30)) <= len(room) == max(bins) + 1


def test_sequences_and_vocabulary(spark):
    assert packing.tokenizer_ranks(queries.TOKENIZER) == load_ranks(queries.RANKS)
    docs = [(n, f"text {n} " * (n + 1)) for n in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    packed = packing.pack(df, queries.TOKENIZER, PATTERN, capacity=64, with_ids=True)
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        part = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_added_tokens_get_the_ids_of_the_library_as_it_is(spark, tmp_path):
    t = Tokenizer.from_file(queries.TOKENIZER)
    end = "<|endoftext|>"
    texts = ["a" + end + "b", end, end * 3, " x " + end + "  y\n", "plain  text", None, "", "<|endoftext", "é" + end + " " + "word " * 3000 + end]
    want = {n: [*t.encode(x or "", add_special_tokens=False).ids, 0] for n, x in enumerate(texts)}
    assert want[0] == [64, 50256, 65, 0]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in queries.op9_bounded_best_fit(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for n, ids in want.items():
        for start, length, crc in got[n]:
            assert zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
        assert sum(r[1] for r in got[n]) == len(ids)


def test_texts_are_encoded_in_small_slices(spark, monkeypatch):
    """What a worker holds at a time does not grow with the batch that Spark hands it."""
    sizes = []

    class Recording:
        def column(self, texts):
            sizes.append(sum(len(t) for t in texts.to_pylist()))
            return np.zeros(len(texts), np.uint32), np.ones(len(texts), np.int64)

    monkeypatch.setattr(packing, "_encoder", lambda path, pattern: Recording())
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = packing.pieces(docs, "", "")
    texts = ["x" * 2000] * 4000
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array(texts)], ["row_id", "id", "text"])
    out = list(run(iter([batch])))
    assert sum(sizes) == 8_000_000 and max(sizes) <= (1 << 20) + 2000
    assert [r for b in out for r in b.column("id").to_pylist()] == list(range(4000))


def test_texts_are_handed_over_in_small_batches(spark, monkeypatch):
    """Neither side of the pipe holds 10,000 texts at a time, and the session keeps its setting."""
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)
    plain = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df: seen.append(spark.conf.get(setting)) or plain(df))
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    packing.pack(docs, queries.TOKENIZER, PATTERN).collect()
    assert int(seen[0]) == packing.BATCH and set(seen[1:]) == {before} and spark.conf.get(setting) == before
    spark.conf.set(setting, "7")
    try:
        packing.pack(docs, queries.TOKENIZER, PATTERN).collect()
        assert seen[-1] == spark.conf.get(setting) == "7"
    finally:
        spark.conf.set(setting, before)


def test_tasks_that_encode_nothing_empty_the_encoders_tables(spark, monkeypatch):
    """Workers outlive their stage: what packing has learned does not stand beside later stages."""
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    tasks = [neardup.sets_of(docs, "text"), neardup.shingled(docs, "text", "doc_id"), langid.identify(docs, langid.Model([], np.zeros((0, langid.DIM)), []))]
    for run in tasks:
        first = packing._encoder(queries.TOKENIZER, PATTERN)
        assert packing._encoder(queries.TOKENIZER, PATTERN) is first
        list(run(iter([])))
        assert not any(made.cache_info().currsize for made in bpe._KEPT)
