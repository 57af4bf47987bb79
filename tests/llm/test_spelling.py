import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling
from tidemark.llm.queries import op12_trie_pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, factor=5):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def rows(df):
    found = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_near_words_against_brute_force(spark):
    base = ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abababab", "ababab", "abababa", "ététion", "Ététion", "letters", "lettres", "leters", "lettters", "xetters"]
    counts = {w: 5 * (i % 3 + 1) for i, w in enumerate(base)}
    for n, c in enumerate("bcdefgh"):
        counts[f"letter{c}"] = 5 * 6**n
        counts[f"{c}etters"] = 7  # ties
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert rows(spelling.grouped(df)) == brute(counts)


def test_chains_are_followed_to_the_end(spark):
    words = ["aaaaaa"]
    for k in range(6):
        words.append(words[-1][:k] + "b" + words[-1][k + 1 :])
    counts = {w: 5 * 5**n for n, w in enumerate(words)}
    found = rows(spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert found == brute(counts)
    assert {r[2] for r in found} == {"bbbbbb"}


def test_a_long_word(spark):
    word = "abcdefghij" * 300
    counts = {word: 50, word[:-1]: 5, word[:1500] + "z" + word[1500:]: 5, word[:70] + "z" + word[71:]: 6}
    found = rows(spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[0]: r[4] for r in found} == {word: 3, **{w: 1 for w in counts if w != word}}
    assert {r[2] for r in found} == {word}


def test_random_words(spark):
    import random

    rng = random.Random(4)
    counts = {}
    for _ in range(900):
        counts["".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))] = rng.randint(5, 400)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows(spelling.grouped(df)) == brute(counts)


def test_odd_documents(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "12 34"), (None, "Letters letters LETTERS letters letters"), (4, "letterß " * 6), (4, "letterß " * 6)]
    docs += [(n, "Été hélènes hélenes hXlènes x" + "y" * 3000 + " word_letters") for n in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = rows(op12_trie_pairs(spark, str(tmp_path)))
    assert found == brute(brute_words(docs)) and any(r[1] for r in found)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_trie_pairs(spark, str(tmp_path)).collect() == []


def test_letters_outside_the_alphabet_are_refused(spark):
    with pytest.raises(Exception, match="above U"):
        spelling.grouped(spark.createDataFrame([("中" * 6, 5)], "word string, n long")).collect()


def test_whole_test_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    counts = brute_words(docs)
    found = rows(op12_trie_pairs(spark, sf_dir))
    assert {r[0]: r[3] for r in found} == counts
    by_skip = {}
    for w in counts:
        for k in {w, *(w[:i] + "\0" + w[i + 1 :] for i in range(len(w))), *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_skip.setdefault(k, set()).add(w)
    near = {w: set() for w in counts}
    for group in by_skip.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    assert {r[0]: r[4] for r in found} == {w: len(v) for w, v in near.items()}
