"""Language identification: held-out accuracy, the rows it learns from, and odd texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import langid, queries


def folds(key):
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in queries.table(spark, folder, "documents").collect()}
    rows = queries.op10_family_svm(spark, folder).collect()
    assert len(rows) == len(docs) and all(r.held_out == folds(r.doc_id) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang is not None]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def texts(rng, letters, n):
    return [" ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(rng.randint(3, 30))) for _ in range(n)]


LANGUAGES = {"en": "thewisand", "de": "unddersch", "nl": "ijvaneeng", "fr": "leséaioux", "zz": "qkxvwjp"}


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(9), []
    for lang, letters in LANGUAGES.items():
        rows += [(len(rows) + n, t, lang, "x") for n, t in enumerate(texts(rng, letters, 60))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_families_and_languages_without_one(spark, docs):
    model = langid.train(docs)
    assert [f for f, _ in model.families] == ["germanic", "romance", "zz"]
    assert [len(p) for p in model.language_pairs] == [3, 0, 0]
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = out.collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_odd_texts(spark, docs):
    model = langid.train(docs)
    odd = [None, "", " \n", "123 ... !!", "\U0001f600", "é", "a", "thewisand " * 300_000, "x" * 5_000_000, "٣٤"]
    frame = spark.createDataFrame([(1, t, None) for t in odd], "doc_id long, text string, lang_pred int")
    got = {r.text: (r.lang_pred, r.score) for r in langid.identify(frame, model).collect()}
    assert {t for t, (p, _) in got.items() if p == "und"} == {None, "", " \n", "123 ... !!", "\U0001f600", "٣٤"}
    assert got["thewisand " * 300_000][0] == "en" and got[None] == ("und", 0.0)
    assert langid.identify(frame.limit(0), model).collect() == []


def test_prediction_does_not_depend_on_neighbours(docs):
    model = langid.train(docs)
    some = [r.text for r in docs.limit(40).collect()] + [None, "a"]
    together = model.predict(pa.array(some))
    assert [model.predict(pa.array([t], pa.string()))[0][0] for t in some] == together[0]


def test_held_out_and_unlabelled_rows_are_not_learned(spark, docs):
    def frame(change):
        rows = [(r.doc_id, *change(r), r.score) for r in docs.collect()]
        return spark.createDataFrame(rows, docs.schema)

    a = langid.train(docs)
    b = langid.train(frame(lambda r: ("q" * 50, "de") if folds(r.doc_id) else (r.text, r.lang)))
    assert a.families == b.families and np.array_equal(a.family_pairs, b.family_pairs)
    none = langid.train(frame(lambda r: (r.text, None)))
    assert none.predict(pa.array(["the", None]))[0] == ["und", "und"]
    one = langid.train(frame(lambda r: (r.text, "en")))
    assert one.predict(pa.array(["anything", "1"])) [0] == ["en", "und"]


def test_sample_is_bounded(docs):
    small = langid.train(docs, size=10)
    assert sorted(c for _, codes in small.families for c in codes) == sorted(LANGUAGES)
