"""The transducer and the column encoder against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, queries
from tidemark.llm.transducer import START, Transducer, load_ranks

PATTERN = public_tokenizers.PATTERN
RANKS = load_ranks(queries.RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b\n\n  c  　d   e", "it's  we'll 'S\r\n\t x\n",
    "<|endoftext|> a", "\U0001f600\U0001f468‍\U0001f469 é ̀", "1²3 ٣༳",
    "\x1c \x85 z", "\x00\x01 \x7f", "a" * 9000, "ab " * 4000 + "é" * 5000, "x",
]


def ids_of(encoder, texts):
    ids, counts = encoder.column(pa.array(texts, pa.string()))
    assert len(ids) == counts.sum()
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, PATTERN)


def test_odd_texts_and_random_white_space(encoder):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(" \n\t ab'sé1.,  ", k=30)) for _ in range(3000)]
    assert ids_of(encoder, texts) == [LIBRARY.encode_ordinary(t or "") for t in texts]
    assert ids_of(encoder, []) == [] and ids_of(encoder, [None]) == [[]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=5))
def test_any_texts(texts):
    encoder = bpe.encoder(queries.RANKS, PATTERN)
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids_of(encoder, texts) == [LIBRARY.encode_ordinary(t or "") for t in texts]


def test_a_full_table_is_emptied():
    rng = random.Random(4)
    small = Transducer(RANKS, max_states=50)
    words = [bytes(rng.choices(b"abcthe", k=rng.randint(1, 12))) for _ in range(300)] + [b"the" * 40, b""]
    ids, counts = small.encode_all(words)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [LIBRARY._encode_single_piece(w) if w else [] for w in words]


def test_streaming_emits_settled_tokens_with_bounded_lookahead():
    rng = random.Random(5)
    piece = bytes(rng.choices(b"abthe in", k=5000))
    transducer = Transducer(RANKS)
    groups = list(transducer.stream(piece, block=64))
    assert len(groups) > 50
    assert [t for g in groups for t in g] == LIBRARY._encode_single_piece(piece)
    assert transducer.encode_all([])[0].tolist() == []
    assert transducer.step(START, b"a")[1] == RANKS[b"a"]


def test_utf8_stream_byte_by_byte():
    whole = "aé€\U0001f600z".encode() + b"\xff\xc3(\xe2\x82\xf0\x9f\x98\xed\xa0\x80\xf4\x90\x80\x80\xc0\xaf\xe2\x82"
    for size in (1, 2, 3, 5, len(whole)):
        stream = bpe.Utf8Stream()
        text = "".join(stream.feed(whole[n : n + size]) for n in range(0, len(whole), size)) + stream.finish()
        assert text == whole.decode("utf-8", "replace")


def test_columns_in_and_out(spark):
    rows = [(n, t, "kept") for n, t in enumerate(ODD)] + [(0, "twice", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs, queries.RANKS, PATTERN)
    assert coded.columns == ["doc_id", "text", "ids", "n_tokens"]
    for r in bpe.decode(coded, queries.RANKS).collect():
        want = LIBRARY.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == (r.text or "")
    assert bpe.encode(docs.limit(0), queries.RANKS, PATTERN).collect() == []


def test_query_equals_library(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    rows = queries.op7_transducer_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_tables_hold_no_empty_transitions():
    """A state with several transitions costs what they are, not a row with a column per byte."""
    t = Transducer(RANKS)
    rng = random.Random(5)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    ids, counts = t.encode_all(pieces)
    assert b"".join(t.bytes_of[i] for i in ids.tolist()) == b"".join(pieces) and len(counts) == len(pieces)
    held = sum(v.nbytes for k, v in vars(t).items() if isinstance(v, np.ndarray) and k != "sizes")
    assert held < 64 * len(t.states)
