import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import repetition
from tidemark.llm.queries import QUERIES, SQL, op11_suffix_repeats

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat", "base_failed", "kept")


def brute_longest(words):
    out = []
    for i in range(len(words)):
        most = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            most = max(most, k)
        out.append(most)
    return out


def brute(text, limits=repetition.Limits()):
    text = text or ""
    words = [(m.group(), len(text[: m.start()].encode()), len(text[: m.end()].encode())) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    plain = [w for w, *_ in words]
    longest = brute_longest(plain)
    chars = sum(map(len, plain))
    windows = [tuple(plain[i : i + limits.window]) for i in range(len(plain) - limits.window + 1)]
    twice = {w for w in windows if windows.count(w) > 1}
    in_window = {i + k for i, w in enumerate(windows) if w in twice for k in range(limits.window)}
    covered = {i + k for i, n in enumerate(longest) if n >= limits.repeat for k in range(n)}
    spans = []
    for i in sorted(covered):
        if spans and i - 1 in covered:
            spans[-1][1] = words[i][2]
        else:
            spans.append([words[i][1], words[i][2]])
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat_chars = sum(len(plain[i]) for i in covered)
    base = len(plain) < limits.words or 100 * len(in_window) > limits.window_percent * len(plain)
    fits = 100 * repeat_chars <= limits.covered_percent * chars and max(longest, default=0) <= limits.longest
    symbols = sum(c in "#*$%&|<>" for c in text)
    found = (len(plain), chars, symbols, len(lines) - len(set(lines)), len(in_window), repeat_chars, max(longest, default=0), base, not base and fits)
    return found, [tuple(s) for s in spans]


@pytest.mark.parametrize("letters", [1, 2, 3, 9, 200])
def test_longest_repeats_against_brute_force(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 2, 3, 8, 65, 200):
        symbols = rng.integers(0, letters, n).astype(np.uint64)
        assert repetition.longest_repeats(symbols).tolist() == brute_longest(symbols.tolist())


def test_the_suffix_array_is_sorted():
    symbols = np.random.default_rng(0).integers(0, 3, 300)
    array, shared = repetition.common_prefixes(repetition.suffix_ranks(symbols))
    suffixes = [tuple(symbols[i:]) for i in array]
    assert suffixes == sorted(suffixes)
    for a, b, k in zip(suffixes, suffixes[1:], shared[1:]):
        assert a[:k] == b[:k] and a[: k + 1] != b[: k + 1]


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 2)))
    passage = " ".join(word() for _ in range(14))
    texts = [None, "", " \n\t", "one", "a " * 300, "é#*$ <b>\r\nx\n\nx\n x\nx  y", "\x1f\x1c a\x0bb\x0cc"]
    texts += [" ".join(word() for _ in range(n)) for n in (3, 49, 50, 51, 120)]
    texts += [f"{passage} {' '.join(str(k) for k in range(n))} {passage}" for n in (30, 60, 120)]
    texts += ["\n".join(f"line {k % 5} of {k}" for k in range(40)), " ".join(f"w{k}" for k in range(110)) * 2]
    texts += [" ".join(f"w{k}" for k in range(105)) + " " + " ".join(f"v{k}" for k in range(800)) + " " + " ".join(f"w{k}" for k in range(105))]
    return texts + texts[-3:]


def test_odd_texts(spark):
    rows = list(enumerate(odd_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in repetition.judged(df, spans=True).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        found, spans = brute(text)
        assert tuple(got[doc_id][c] for c in NAMES) == found, text
        assert [(s.start, s.stop) for s in got[doc_id].repeat_spans] == spans, text
        assert got[doc_id].text == text
    assert {r.kept for r in got.values() if not r.base_failed} == {True, False}


def test_a_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(400_000)) + " x" * 1000 + "y" * 5_000_000
    df = spark.createDataFrame([(1, text), (2, "z " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.judged(df).drop("text").collect()}
    assert (got[1].n_words, got[1].longest_repeat, got[1].n_repeat_words) == (401_000, 998, 999)
    assert (got[2].n_words, got[2].longest_repeat, got[2].kept) == (200_000, 199_999, False)


def test_query_on_odd_rows_equals_sql(spark, tmp_path):
    import duckdb

    rows = list(enumerate(odd_texts()))
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL["op11_suffix_repeats"])
    names = [c[0] for c in want.description]
    got = QUERIES["op11_suffix_repeats"](spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
    assert sorted(got.columns) == sorted(names)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op11_suffix_repeats(spark, str(tmp_path)).collect() == []


def test_clean_documents_are_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    good = repetition.judged(docs.filter("quality = 1")).filter("not base_failed")
    assert good.count() > 20 and good.filter("not kept").count() == 0
