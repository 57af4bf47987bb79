"""Word shingles, one-permutation signatures and band keys of whole texts, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, after lower-casing A-Z. Words, shingles and bands are 64-bit hashes; sets
are compared by these. A text of fewer words than a shingle takes is one shingle; a text
without words, or null, has none.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; longer words are hashed by themselves.
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

# odd constants with well-mixed bits: 2**64 over the golden ratio, and a multiple of it
STEP = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64((0x9E3779B97F4A7C15 * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the 64 (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * FOLD
    x = x ^ (x >> np.uint64(29))
    x = x * STEP
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        back = np.uint64(pow(int(STEP), -1, 1 << 64))
        return (
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, STEP)])),
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, back)])),
        )


def hash_words(text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each word: a polynomial in its bytes from differences of running sums."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    long = np.flatnonzero(stops - starts > BLOCK // 4)
    for n in long:
        out[n] = int.from_bytes(hashlib.blake2b(text[starts[n] : stops[n]].tobytes(), digest_size=8).digest(), "little")
    short = np.ones(len(starts), bool)
    short[long] = False
    at = np.flatnonzero(short)
    while len(at):
        base = starts[at[0]]
        fit = int(np.searchsorted(stops[at], base + BLOCK, "right"))
        now, at = at[:fit], at[fit:]
        block = text[base : stops[now[-1]]].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(block * up[: len(block)], dtype=np.uint64)])
        a, b = starts[now] - base, stops[now] - base
        out[now] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return out


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    text = LOWER[raw]
    inside = ~SPACE[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(text)]
    begins[edge] = inside[edge]  # a text starts a word of its own
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = hash_words(text, starts, stops)
    first = np.searchsorted(starts, offsets)
    rows = hashes[: len(hashes) - words + 1].copy() if len(hashes) >= words else hashes[:0]
    for n in range(1, words):
        rows = rows * STEP + hashes[n : n + len(rows)]
    rows = mix(rows)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            found = np.sort(rows[a : b - words + 1])
            keep = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            out.append(found[keep])
        elif b > a:
            whole = b - a
            for h in hashes[a:b].tolist():
                whole = (whole * int(FOLD) + h) & (1 << 64) - 1
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(rows[:0])
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """For every bin the order in which it asks others for their value when it is empty."""
    rng = np.random.default_rng(bins)
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures: the smallest hash per bin, empty bins filled by probing.

    The bin is the hash's leading bits. An empty bin takes the value of the first occupied
    bin in an order of its own, so each empty bin matches another text's independently.
    Sets must not be empty.
    """
    shift = np.uint64(64 - (bins.bit_length() - 1))
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for n, found in enumerate(sets):
        place = (found >> shift).astype(np.int64)
        first = np.ones(len(place), bool)
        np.not_equal(place[1:], place[:-1], out=first[1:])
        out[n, place[first]] = found[first]
        full[n, place[first]] = True
    probes = _probes(bins)
    row, col = np.nonzero(~full)
    filled = out.copy()
    turn = 0
    while len(row):
        source = probes[col, turn]
        hit = full[row, source]
        filled[row[hit], col[hit]] = out[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
        turn += 1
    return filled


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` bins, different between bands."""
    bands = signature.reshape(len(signature), signature.shape[1] // rows, rows)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * STEP, bands.shape[:2]).copy()
    for n in range(rows):
        key = mix(key * FOLD + bands[:, :, n])
    return key.view(np.int64)
