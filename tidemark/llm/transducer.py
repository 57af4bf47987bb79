"""Byte-pair merges as a finite-state transducer whose states are made when first met.

Reading a piece byte by byte, the encoding of every prefix is the encoding of a shorter
prefix plus one last token. A token may follow another exactly when merging the two side
by side would not join bytes across their border, and for each position exactly one token
ending there fits. So it is enough to remember the last token at each position a later
token could still start from: those inside the longest suffix read so far that begins a
vocabulary entry. A state is that suffix with those tokens; it outputs the last token at
the position just read. Following last tokens backwards gives the encoding. Tokens before
a border that all open positions go back through are settled and can be emitted: a long
piece is emitted block by block with a lookahead of a few entries.

States are numbered as they appear. The first transition of a state is kept beside it, the
others in one sorted list for all states, so a whole column of pieces advances one byte at a
time by lookups. All is emptied when there are ``max_states``.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a ``.tiktoken`` file: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Full(Exception):
    pass


#: Marks a position no token can start from any more.
CLOSED = -1
#: Nothing read: the next token starts a piece.
START: tuple[bytes, tuple] = (b"", (None,))
#: States added to the arrays at a time.
GROW = 16_384
BYTES = [bytes([b]) for b in range(256)]
#: Pieces longer than this are read alone, block by block.
LONG = 4096
#: Pairs of tokens, and suffixes, whose facts are remembered.
PAIRS = 1 << 19
SUFFIXES = 1 << 17


class Transducer:
    """Encoder for single pieces under merge ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self.ranks = ranks
        self.max_states = max_states
        self.prefixes = {token[:n] for token in ranks for n in range(len(token))}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self._crowded = False
        self._reset()

    # -- which token may follow which

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two parts whose merge makes a token, or None for a single byte."""
        if token not in self._parts:
            text = self.bytes_of[token]
            parts = [text[n : n + 1] for n in range(len(text))]
            while len(parts) > 2:
                rank, n = min(
                    (self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1)
                )
                if rank == 1 << 60:
                    break
                parts[n : n + 2] = [parts[n] + parts[n + 1]]
            self._whole[token] = len(parts) <= 2
            self._parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._parts[token]

    def _reachable(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        self._split(token)
        return self._whole[token]

    def _spine(self, token: int, side: int) -> tuple[int, ...]:
        """The token at its first (side 0) or last byte, from the byte up to itself."""
        known = self._spines[side].get(token)
        if known is None:
            parts = self._split(token)
            known = (token,) if parts is None else (*self._spine(parts[side], side), token)
            self._spines[side][token] = known
        return known

    def fits(self, left: int | None, right: int) -> bool:
        """Whether no merge crosses the border between two tokens.

        Merges inside a token happen in order of rank, so rank serves as time: the pair
        at the border is joined if its rank comes before the next merge on the left, and
        not after the next on the right (of equal ranks the leftmost goes first).
        """
        if left is None:
            return self._reachable(right)
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._reachable(right) and self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        ends, starts = self._spine(left, 1), self._spine(right, 0)
        never = 1 << 60
        ranks, bytes_of = self.ranks, self.bytes_of
        n = m = 0
        while True:
            next_left = ends[n + 1] if n + 1 < len(ends) else never
            next_right = starts[m + 1] if m + 1 < len(starts) else never
            joined = ranks.get(bytes_of[ends[n]] + bytes_of[starts[m]], never)
            if joined < next_left and joined <= next_right and joined < never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                n += 1
            else:
                m += 1

    # -- states

    def _reset(self) -> None:
        self.states: list[tuple[bytes, tuple]] = [START]
        self.numbers: dict[tuple[bytes, tuple], int] = {START: 0}
        self.token = np.full(GROW, -1, np.int32)
        # first transition of each state; the others by 256 * state + byte, up to a key that none has
        self.byte = np.full(GROW, -1, np.int16)
        self.after = np.full(GROW, -1, np.int32)
        self.others = np.array([np.iinfo(np.int64).max])
        self.targets = np.array([-1], np.int32)
        self._suffixes: dict[bytes, tuple] = {}

    def _facts(self, suffix: bytes) -> tuple:
        """Tokens that end a suffix with their starts, what of it stays, and the last tokens to pick.

        Positions no token can start from pick the last entry, which is ``CLOSED``.
        """
        if len(self._suffixes) >= SUFFIXES:
            self._suffixes.clear()
        ends = tuple((n, self.ranks[suffix[n:]]) for n in range(len(suffix)) if suffix[n:] in self.ranks)
        start = 0
        while suffix[start:] not in self.prefixes:
            start += 1
        picks = [n if suffix[n:] in self.prefixes else -1 for n in range(start, len(suffix) + 1)]
        pick = itemgetter(*picks) if len(picks) > 1 else itemgetter(slice(picks[0], picks[0] + 1))
        facts = self._suffixes[suffix] = (ends, suffix[start:], pick)
        return facts

    def step(self, state: tuple[bytes, tuple], byte: bytes) -> tuple[tuple[bytes, tuple], int]:
        """The state after one more byte and the last token of what has been read."""
        suffix, lasts = state
        suffix += byte
        ends, rest, pick = self._suffixes.get(suffix) or self._facts(suffix)
        for start, token in ends:
            last = lasts[start]
            if last is not CLOSED and self.fits(last, token):
                return (rest, pick((*lasts, token, CLOSED))), token
        raise ValueError(f"no token of the vocabulary ends at {suffix!r}")

    def _learn(self, keys: np.ndarray) -> None:
        """Transitions of sorted keys 256 * state + byte that are not known yet."""
        states, numbers, step = self.states, self.numbers, self.step
        after, tokens = [], []
        for key in keys.tolist():
            found, token = step(states[key >> 8], BYTES[key & 255])
            n = numbers.get(found)
            if n is None:
                n = numbers[found] = len(states)
                if n >= self.max_states:
                    raise _Full
                states.append(found)
                tokens.append(token)
            after.append(n)
        while len(self.token) < len(states):
            for name in ("token", "byte", "after"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full(GROW, -1, old.dtype)]))
        self.token[len(states) - len(tokens) : len(states)] = tokens
        state, byte, to = keys >> 8, keys & 255, np.array(after, np.int32)
        first = self.byte[state] < 0
        first[1:] &= state[1:] != state[:-1]
        self.byte[state[first]], self.after[state[first]] = byte[first], to[first]
        if not first.all():
            keys, to = keys[~first], to[~first]
            at = np.searchsorted(self.others, keys)
            self.others, self.targets = np.insert(self.others, at, keys), np.insert(self.targets, at, to)

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after a byte each, -1 where not known."""
        after = np.where(self.byte[state] == byte, self.after[state], -1)
        rest = np.flatnonzero(after < 0)
        keys = state[rest].astype(np.int64) << 8 | byte[rest]
        at = np.searchsorted(self.others, keys)
        after[rest] = np.where(self.others[at] == keys, self.targets[at], -1)
        return after

    # -- runs

    def stream(self, piece: bytes, block: int = LONG) -> Iterator[list[int]]:
        """Tokens of one piece in settled groups, without tables."""
        state, base, lasts = START, 0, array("i")
        size = lambda n: len(self.bytes_of[lasts[n - base - 1]])
        for n in range(len(piece)):
            state, token = self.step(state, piece[n : n + 1])
            lasts.append(token)
            if len(lasts) < block or (n + 1) % block:
                continue
            ends = {n + 1 - k for k, x in enumerate(reversed(state[1])) if x is not CLOSED}
            while len(ends) > 1 and max(ends) > base:  # the latest border that all go back through
                ends.add((end := max(ends)) - size(end))
                ends.discard(end)
            yield self._back(lasts, border := max(max(ends) - base, 0))
            lasts, base = lasts[border:], base + border
        yield self._back(lasts, len(lasts))

    def _back(self, lasts: array, end: int) -> list[int]:
        ids = []
        while end > 0:
            ids.append(lasts[end - 1])
            end -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def encode_all(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and the number of ids of each."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return self.encode_bytes(np.frombuffer(b"".join(pieces), np.uint8), lens)

    def encode_bytes(self, text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that stand one after the other in an array of bytes."""
        long = np.flatnonzero(lens > LONG)
        if len(lens) == 1 and (len(long) or self._crowded):
            ids = np.fromiter((t for group in self.stream(text.tobytes()) for t in group), np.uint32)
            return ids, np.array([len(ids)], np.int64)
        if len(long) == 0:
            try:
                return self._run(text, lens)
            except _Full:
                self._crowded = len(lens) <= 2
                self._reset()
            cuts = [0, len(lens) // 2, len(lens)]
        else:
            cuts = sorted({0, len(lens), *long.tolist(), *(long + 1).tolist()})
        stops = np.concatenate([[0], np.cumsum(lens)])
        done = [self.encode_bytes(text[stops[a] : stops[b]], lens[a:b]) for a, b in zip(cuts, cuts[1:])]
        self._crowded = False
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _run(self, text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-lens, kind="stable")
        starts, by_len = (np.cumsum(lens) - lens)[order], lens[order]
        state = np.zeros(len(lens), np.int32)
        lasts = np.empty(len(text), np.int32)
        for n in range(int(by_len[0]) if len(lens) else 0):
            alive = int(np.searchsorted(-by_len, -n, "left"))
            at = starts[:alive] + n
            byte = text[at]
            after = self._next(state[:alive], byte)
            new = np.flatnonzero(after < 0)
            if len(new):
                self._learn(np.unique(state[new].astype(np.int64) << 8 | byte[new]))
                after[new] = self._next(state[new], byte[new])
            state[:alive] = after
            lasts[at] = self.token[after]
        # walk back from the end of every piece; a token stands where it ends
        ends = np.zeros(len(text), bool)
        first, at = np.cumsum(lens) - lens, np.cumsum(lens)
        going = np.flatnonzero(lens)
        first, at = first[going], at[going]
        while len(at):
            ends[at - 1] = True
            at = at - self.sizes[lasts[at - 1]]
            more = at > first
            first, at = first[more], at[more]
        seen = np.concatenate([[0], np.cumsum(ends)])
        stops = np.cumsum(lens)
        return lasts[ends].astype(np.uint32), seen[stops] - seen[stops - lens]
