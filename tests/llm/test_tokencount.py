"""Token attribution against offsets of the tokenizers library and plain loops."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import queries, tokencount

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.TOKENIZER)
    t.encode_special_tokens = True
    return t


def spans_of(text):
    cuts = [0, *(n + 1 for n, c in enumerate(text) if c == "\n" and n + 1 < len(text)), len(text)]
    return list(zip(cuts, cuts[1:]))


def plain(library, text, spans, rule):
    encoded = library.encode(text, add_special_tokens=False)
    counts, crossing = Counter(), Counter()
    size = queries.bpe.decoder(queries.RANKS).size
    raw, at = text.encode(), 0
    starts = [n for n, b in enumerate(raw) if b & 0xC0 != 0x80]
    char = lambda b: sum(s <= b for s in starts[: b + 1]) - 1 if len(raw) < 500 else len(raw[: b + 1].decode("utf-8", "ignore")) - 1
    where = lambda c: next((n for n, (a, b) in enumerate(spans) if a <= c < b), -1)
    for token in encoded.ids:
        a, b = char(at), char(at + int(size[token]) - 1)
        at += int(size[token])
        held = Counter(where(c) for c in range(a, b + 1))
        if rule == "majority":
            most = max(held.values())
            pick = min((n for n in held if held[n] == most), key=lambda n: a - 1 if n < 0 else spans[n][0])
        else:
            pick = where(a if rule == "start" else b)
        counts[pick] += 1
        crossing[pick] += where(a) != where(b)
    rows = [(n, a, b, counts[n], crossing[n]) for n, (a, b) in enumerate(spans)]
    return sorted(rows + ([(-1, -1, -1, counts[-1], crossing[-1])] if counts[-1] else []))


def result(df):
    got = defaultdict(list)
    for r in df.collect():
        got[r.doc_id].append((r.section, r.start, r.end, r.n_tokens, r.n_crossing))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_lines(spark, library, rule):
    rng = random.Random(2)
    texts = [None, "", "\n", "\n\n\n", "a\n\n\n\nb", "one\ntwo  \n\n  three\n", "é\n\U0001f600 x\n世界\n", " \n \n a"]
    texts += ["".join(rng.choices("\n\n ab.é世\U0001f600", k=rng.randint(1, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(n, t, "s", 0) for n, t in enumerate(texts)], "doc_id long, text string, section string, start int")
    got = result(tokencount.attribute(docs, queries.RANKS, PATTERN, rule=rule))
    assert got == {n: plain(library, t or "", spans_of(t or ""), rule) for n, t in enumerate(texts)}


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_given_sections_with_gaps(spark, library, rule):
    texts = ["The quick brown fox", "éé世界 \U0001f600\U0001f600!", "", None, "no sections", "all"]
    spans = [[(2, 6), (6, 8), (12, 19)], [(1, 3), (5, 6)], [], [], None, [(0, 3)]]
    docs = spark.createDataFrame(list(zip(range(6), texts, spans)), "doc_id long, text string, sections array<struct<start:int,end:int>>")
    got = result(tokencount.attribute(docs, queries.RANKS, PATTERN, sections="sections", rule=rule))
    want = {n: plain(library, t or "", s or [], rule) for n, (t, s) in enumerate(zip(texts, spans))}
    assert got == {n: rows for n, rows in want.items() if rows}


def test_fields_and_totals(spark, library):
    rows = [(1, "title é", None, "body text here"), (2, None, None, None), (1, "", "x", "y")]
    df = tokencount.with_fields(spark.createDataFrame(rows, "doc_id long, a string, b string, c string"), ["a", "b", "c"])
    out = tokencount.attribute(df, queries.RANKS, PATTERN, sections="sections", rule="start")
    sums = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    texts = {1: ["title é\n\nbody text here", "\nx\ny"], 2: ["\n\n"]}
    assert {r.doc_id: r.n for r in sums.collect()} == {k: sum(len(library.encode(t).ids) for t in v) for k, v in texts.items()}
    with pytest.raises(ValueError):
        tokencount.attribute(df, queries.RANKS, PATTERN, rule="none")


def test_query_totals(spark, sf_dir):
    whole = {r.doc_id: r.n_tokens for r in queries.op7_transducer_bpe(spark, sf_dir).collect()}
    out = queries.op6_offset_sections(spark, sf_dir)
    assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == whole
    assert out.limit(0).collect() == []
