"""Repetition inside texts by suffix arrays over their words.

The words of a slice of texts are one sequence in which a word of one text is a symbol of
its own, so that suffixes of different texts share nothing. Suffixes are ranked by prefix
doubling: in each round only those that are not yet told apart are ranked anew, by their
first 2^t words and the 2^t after these. The ranks of every round give the longest common
prefix of neighbours in the array. A suffix shares its longest common prefix with one of
its two neighbours; that is the depth of the innermost interval it lies in, and the words
it spans are an occurrence of a repeated substring that no longer one begins with. Those
that the word before would not extend are the occurrences of maximal repeats. Spans of
maximal repeats of enough words are united.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return, in its own spelling; words and lines are told apart by 64-bit hashes. Null
and empty texts have no words and fail the base rules. Rows are judged each by itself, so
repeated rows get the same verdict, and an empty table gives no rows. Texts of any length
are taken whole: a slice holds about ``SLICE`` bytes of them, or one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .shingles import SPACE, STEP, hash_words, mix

#: Bytes of text worked on at a time.
SLICE = 4 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """When a text is kept."""

    #: base rules: least number of words, most percent of words in repeated windows
    words: int = 50
    window: int = 3
    window_percent: int = 50
    #: a repeat counts towards the covered characters from this many words on
    repeat: int = 10
    #: most percent of the characters of words that repeats may cover
    covered_percent: int = 30
    #: most words of a single repeat
    longest: int = 100


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols; the last are all different.

    A rank is the place in the array of the first suffix that is not told apart from this
    one, so ranks that are settled stay. A suffix that ends is less than any that goes on.
    """
    n = len(symbols)
    _, first, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[first].astype(np.int64)
    levels = [rank]
    open_ = np.flatnonzero(counts[first] > 1)
    step = 1
    while len(open_):
        after = open_ + step
        key = rank[open_] * (n + 1)
        inside = after < n
        key[inside] += rank[after[inside]] + 1
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        old = rank[open_]
        outer = np.ones(len(key), bool)
        np.not_equal(old[1:], old[:-1], out=outer[1:])
        at = np.arange(len(key))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        begin_outer = np.maximum.accumulate(np.where(outer, at, 0))
        rank = rank.copy()
        rank[open_] = old + begin - begin_outer
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        open_ = open_[np.repeat(size > 1, size)]
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the length of the prefix each entry shares with the one before."""
    n = len(levels[0])
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    shared = np.zeros(n, np.int64)
    pair = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    a, b = array[pair], array[pair - 1]
    length = np.zeros(len(pair), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = np.flatnonzero((x < n) & (y < n))
        same = inside[levels[t][x[inside]] == levels[t][y[inside]]]
        length[same] += 1 << t
    shared[pair] = length
    return array, shared


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For every place the length of the longest substring from there that occurs elsewhere too."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    array, shared = common_prefixes(suffix_ranks(symbols))
    out = np.empty(len(symbols), np.int64)
    out[array] = np.maximum(shared, np.append(shared[1:], 0))
    return out


def _united(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


class _Slice:
    """Words and lines of the texts of a slice."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.edges = self.offsets[:-1][self.offsets[:-1] < len(self.text)]
        inside = ~SPACE[self.text]
        self.inside = inside
        self.starts, self.stops = self._spans(inside)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        points = np.concatenate([[0], np.cumsum(inside & (self.text & 0xC0 != 0x80))])
        self.points = points[self.stops] - points[self.starts]

    def _spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[self.edges] = inside[self.edges]  # a text starts a span of its own
        ends[:-1] &= ~inside[1:] | begins[1:]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def symbols(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(hash_words(self.text, self.starts, self.stops) + self.doc.astype(np.uint64) * STEP)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        seen = np.concatenate([[0], np.cumsum(values)])
        return seen[self.first[1:]] - seen[self.first[:-1]]

    def repeated_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text, per text."""
        starts, stops = self._spans(self.text != 10)
        with_word = np.searchsorted(self.starts, stops) > np.searchsorted(self.starts, starts)
        starts, stops = starts[with_word], stops[with_word]
        doc = np.searchsorted(self.offsets, starts, "right") - 1
        with np.errstate(over="ignore"):
            key = mix(hash_words(self.text, starts, stops) + doc.astype(np.uint64) * STEP)
        _, once = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[once] = False
        return np.bincount(doc[again], minlength=len(self.offsets) - 1)


def _measured(texts: pa.Array, limits: Limits, spans: bool) -> dict[str, pa.Array]:
    part = _Slice(texts)
    n = len(part.starts)
    longest = longest_repeats(part.symbols())
    windows = np.flatnonzero(longest >= limits.window)
    in_window = _united(windows, np.full(len(windows), limits.window), n)
    long = longest >= limits.repeat
    # one that the word before extends lies inside that word's own repeat
    grown = np.zeros(n, bool)
    grown[1:] = (longest[:-1] == longest[1:] + 1) & (part.doc[1:] == part.doc[:-1])
    maximal = np.flatnonzero(long & ~grown)
    covered = _united(maximal, longest[maximal], n)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[part.text])])
    n_words = np.diff(part.first)
    out = {
        "n_words": n_words,
        "word_chars": part.per_text(part.points),
        "n_symbols": symbols[part.offsets[1:]] - symbols[part.offsets[:-1]],
        "n_dup_lines": part.repeated_lines(),
        "n_repeat_words": part.per_text(in_window),
        "repeat_chars": part.per_text(part.points * covered),
        "longest_repeat": np.zeros(len(n_words), np.int64),
    }
    np.maximum.at(out["longest_repeat"], part.doc, longest)
    base = (n_words < limits.words) | (100 * out["n_repeat_words"] > limits.window_percent * n_words)
    fits = (100 * out["repeat_chars"] <= limits.covered_percent * out["word_chars"]) & (out["longest_repeat"] <= limits.longest)
    arrays = {c: pa.array(v.astype(np.int64)) for c, v in out.items()} | {"base_failed": pa.array(base), "kept": pa.array(~base & fits)}
    if spans:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        # a span does not reach into the next text, but two may touch at the border
        cut = np.unique(np.concatenate([begin, part.first[1:-1][covered[np.minimum(part.first[1:-1], n - 1)]] if n else begin]))
        stop = np.minimum(end[np.searchsorted(end, cut, "right")], part.first[1:][part.doc[cut]]) if len(cut) else cut
        base_ = part.offsets[:-1][part.doc[cut]] if len(cut) else cut
        found = pa.StructArray.from_arrays(
            [pa.array(part.starts[cut] - base_, pa.int64()), pa.array(part.stops[stop - 1] - base_, pa.int64())], ["start", "stop"]
        )
        place = np.searchsorted(cut, part.first)
        arrays["repeat_spans"] = pa.ListArray.from_arrays(pa.array(place, pa.int32()), found)
    return arrays


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_chars long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)
SPANS = "repeat_spans array<struct<start: long, stop: long>>"


def judged(docs: DataFrame, text: str = "text", limits: Limits = Limits(), spans: bool = False) -> DataFrame:
    """Adds the measures and the verdict; columns of these names are replaced.

    ``longest_repeat`` is in words. ``spans`` adds ``repeat_spans``, the united spans of
    maximal repeats as places of bytes in the text's UTF-8.
    """
    added = T.StructType.fromDDL(MEASURES + (f", {SPANS}" if spans else ""))
    names = added.fieldNames()
    plain = [c for c in docs.columns if c not in names or c == text]
    schema = T.StructType([docs.schema[c] for c in plain if c not in names] + added.fields)
    kept = [c for c in plain if c not in names]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                found = _measured(part.column("_text"), limits, spans)
                columns = [*part.columns[:-1], *(found[c] for c in names)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)
