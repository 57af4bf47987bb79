"""Byte-level BPE over columns of texts: encode whole texts, decode ids as a stream.

Texts are cut at spaces, every different cut of a batch is split into pieces by the
vocabulary's pattern, and the different pieces run through the transducer. Ids travel as
packed little-endian unsigned 32-bit integers in a binary column.

Null and empty texts have no ids and decode to the empty text. A text of any length is
read whole; a batch is worked on in slices of about ``SLICE`` bytes, or one text if that
is longer.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transducer import Transducer, load_ranks

#: Bytes of text worked on at a time.
SLICE = 4 << 20

#: White space of the pattern, spelt out for expressions that know only that of ASCII.
SPACE = "[\\t-\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A space with white space before it does not start a cut.
GLUED_SPACE = SPACE + " "


class Encoder:
    """Ids of whole columns of texts under one vocabulary and piece pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        glued = pc.match_substring_regex(texts, GLUED_SPACE)
        parts = pc.split_pattern(texts, " ")
        stops = parts.offsets.to_numpy()
        starts, stops = stops[:-1] - stops[0], stops[1:] - stops[0]
        cuts = parts.flatten().dictionary_encode()
        # the first cut of a text has no space before it; a text with glued spaces is one cut
        heads = pc.if_else(glued, texts, pc.list_element(parts, 0)).dictionary_encode()
        keep = np.ones(len(cuts), bool)
        for n in np.flatnonzero(glued.to_numpy(zero_copy_only=False)):
            keep[starts[n] + 1 : stops[n]] = False
        ids, counts, place = self._cuts(cuts.dictionary, heads.dictionary)
        code = place[cuts.indices.to_numpy()]
        code[starts] = place[heads.indices.to_numpy() + len(cuts.dictionary)]
        amount = np.add.reduceat(keep, starts, dtype=np.int64)
        return _spread(ids, counts, code[keep], amount)

    def _cuts(self, cuts: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their number per cut, and where each of ``cuts`` and ``heads`` has its place."""
        letters = pc.match_substring_regex(cuts, "^\\pL+$")  # such a cut is one piece
        spaced = pc.invert(pc.or_(letters, pc.match_substring_regex(cuts, "^$|" + SPACE + "$")))
        single = pc.and_not(pc.invert(letters), spaced)
        mark = lambda m: np.flatnonzero(m.to_numpy(zero_copy_only=False))
        place = np.empty(len(cuts) + len(heads), np.int64)
        place[np.concatenate([mark(letters), mark(spaced), mark(single), np.arange(len(cuts), len(place))])] = np.arange(
            len(place)
        )
        # cuts that end in no white space split alike when they follow each other
        joined = cuts.filter(spaced)
        pieces = self.split("".join([" " + cut for cut in _strings(joined)]))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        amount = [np.ones(len(mark(letters)), np.int64)]
        border = np.cumsum(pc.utf8_length(joined).to_numpy() + 1)
        amount.append(np.diff(np.searchsorted(ends, border, "right"), prepend=0))
        alone = [self.split(cut) for cut in [*(" " + cut for cut in _strings(cuts.filter(single))), *_strings(heads)]]
        amount.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        for found in alone:
            pieces += found
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        words = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), cuts.filter(letters), pa.scalar(" ", pa.large_string()))
        ids, counts = self.transducer.encode_bytes(*_bytes(pa.concat_arrays([words, coded.dictionary])))
        code = np.concatenate([np.arange(len(words)), coded.indices.to_numpy() + len(words)])
        return *_spread(ids, counts, code, np.concatenate(amount)), place


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and how many each value has."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), np.diff(offsets)


def _spread(ids: np.ndarray, counts: np.ndarray, code: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lay out the ids of coded parts; ``amount`` parts make one whole."""
    size = counts[code]
    place = (np.cumsum(counts) - counts)[code]
    stops = np.cumsum(size)
    flat = ids[np.repeat(place - (stops - size), size) + np.arange(int(size.sum()))]
    seen = np.concatenate([[0], stops])
    last = np.cumsum(amount)
    return flat, seen[last] - seen[last - amount]


class Utf8Stream:
    """Text from bytes that arrive in any portions.

    The state is the unfinished character at the end: its bytes so far, and what may
    follow. Bytes that cannot be part of a character become U+FFFD.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def need(lead: int) -> int:
        """How many bytes a character with this first byte has; 0 if none starts so."""
        if lead < 0x80:
            return 1
        return 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    @staticmethod
    def may_follow(lead: int, second: int) -> bool:
        """Whether the second byte keeps the character within what UTF-8 allows."""
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
        return low <= second <= high

    def unfinished(self, data: bytes) -> int:
        """How many bytes at the end are the start of a character."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                starts = self.need(byte) > back and (back == 1 or self.may_follow(byte, data[-back + 1]))
                return back if starts else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data) - self.unfinished(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        text, self.open = self.open.decode("utf-8", "replace"), b""
        return text


class Decoder:
    """Text from ids, in portions of ``portion`` ids."""

    def __init__(self, ranks: dict[bytes, int], portion: int = 1 << 18):
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.size = np.fromiter(map(len, table), np.int64, size)
        self.place = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.portion = portion

    def raw(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        at = np.repeat(self.place[ids] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return self.flat[at].tobytes()

    def text(self, ids: np.ndarray) -> str:
        stream = Utf8Stream()
        out = [stream.feed(self.raw(ids[n : n + self.portion])) for n in range(0, len(ids), self.portion)]
        return "".join([*out, stream.finish()])


_KEPT: list[Callable] = []


def kept(make: Callable) -> Callable:
    """What has been made for the last two vocabularies stays in a worker until ``forget``."""
    made = lru_cache(maxsize=2)(make)
    _KEPT.append(made)
    return made


def forget() -> None:
    """Empty the tables that earlier stages have left in this worker; for tasks that encode nothing."""
    if any(made.cache_info().currsize for made in _KEPT):
        for made in _KEPT:
            made.cache_clear()
        gc.collect()
        give_back()


@kept
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


@kept
def decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def give_back() -> None:
    """Return freed memory to the system, as workers outlive their stage; without glibc only what Arrow has freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text, at least one row each."""
    bytes_ = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(bytes_) // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column of little-endian ids."""
    offsets = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int64)
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), data]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds packed ``ids`` and their number; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (ids, n_tokens)]
    schema = T.StructType(
        [docs.schema[c] for c in kept] + [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())]
    )

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                flat, counts = enc.column(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, packed(flat, counts), pa.array(counts)], schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; null ids give null."""
    kept = [c for c in coded.columns if c != text]
    schema = T.StructType([*(coded.schema[c] for c in kept), T.StructField(text, T.StringType())])

    def run(batches):
        dec = decoder(path)
        for batch in batches:
            column = batch.column(ids)
            texts = [None if b is None else dec.text(np.frombuffer(b, "<u4")) for b in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return coded.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ids, their number and the text decoded from them, in one pass of the texts."""
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("ids", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def run(batches):
        enc, dec = encoder(path, pattern), decoder(path)
        for batch in batches:
            for part in slices(batch, text):
                flat, counts = enc.column(part.column(text))
                stops = np.cumsum(counts)
                texts = [dec.text(flat[b - n : b]) for n, b in zip(counts, stops)]
                columns = [part.column(key), packed(flat, counts), pa.array(counts), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
