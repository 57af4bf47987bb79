"""Cheapest edits that give a conversation legal roles, by searching from both ends at once.

A conversation is a string of symbols, one per turn: 0 to 7 for ``2 * c + t`` with role
class c (system, user, assistant, other) and t = 1 for a truncated turn, 8 for a turn that
must go. A node of the lattice is (turns consumed, what the output ends in); its edges keep,
rerole or delete the next turn, or insert one. Forward and reverse searches settle nodes in
order of cost, at equal cost those with more turns consumed later, so that a node's least
audit is known when it is settled: the only free edges consume a turn. They stop when no
path through two unsettled ends can be as cheap as the best crossing; every crossing of that
cost is then known, and the one with the least audit is taken.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

#: What the output ends in: nothing, a system, a user, or an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (EMPTY, ASSISTANT)
#: Costs of the edits; a truncated turn that stays adds one.
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
MUST_GO = 8
#: What a system, user or assistant turn may follow.
AFTER = {SYSTEM: (EMPTY,), USER: (EMPTY, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}

Edge = tuple[str, int, int]


def _edges(symbol: int | None) -> list[list[Edge]]:
    """Per state (edit, cost, next state); without a symbol, the insertions."""
    out: list[list[Edge]] = [[] for _ in range(4)]
    for role in (USER, ASSISTANT):
        for state in AFTER[role]:
            if symbol is None:
                out[state].append(("I", INSERT, role))
            elif symbol != MUST_GO:
                out[state].append(("R", REROLE + symbol % 2, role))
    if symbol is None:
        return out
    for state in range(4):
        out[state].append(("D", DELETE, state))
    role = symbol // 2 + 1
    for state in AFTER.get(role, ()) if symbol != MUST_GO else ():
        out[state].append(("K", KEEP + symbol % 2, role))
    return out


def _turned(edges: list[list[Edge]]) -> list[list[Edge]]:
    out: list[list[Edge]] = [[] for _ in range(4)]
    for state, found in enumerate(edges):
        for edit, cost, after in found:
            out[after].append((edit, cost, state))
    return out


CONSUME = [_edges(symbol) for symbol in range(9)]
ADD = _edges(None)
CONSUME_BACK = [_turned(edges) for edges in CONSUME]
ADD_BACK = _turned(ADD)


def cheapest(turns: bytes, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost, and of its paths the ASCII-least audit, from state ``start`` to one of ``ends``."""
    n = len(turns)
    # labels (cost, audit) per node; node = 4 * turns consumed + state
    ahead: dict[int, tuple[int, str]] = {start: (0, "")}
    back: dict[int, tuple[int, str]] = {4 * n + e: (0, "") for e in ends}
    heap_a, heap_b = [(0, 0, start)], [(0, 0, e) for e in ends]
    done_a: set[int] = set()
    done_b: set[int] = set()
    best: tuple[int, str] | None = None

    while heap_a and heap_b and (best is None or heap_a[0][0] + heap_b[0][0] <= best[0]):
        if heap_a[0][0] <= heap_b[0][0]:
            cost, at, state = heappop(heap_a)
            node = 4 * at + state
            if node in done_a or ahead[node][0] < cost:
                continue
            done_a.add(node)
            audit = ahead[node][1]
            if at == n and state in ends and (best is None or (cost, audit) < best):
                best = cost, audit
            steps = [(e, c, at, s) for e, c, s in ADD[state]]
            if at < n:
                steps += [(e, c, at + 1, s) for e, c, s in CONSUME[turns[at]][state]]
            for edit, more, place, after in steps:
                far, label = 4 * place + after, (cost + more, audit + edit)
                if far in done_b:
                    rest = back[far]
                    if best is None or label[0] + rest[0] <= best[0]:
                        whole = (label[0] + rest[0], label[1] + rest[1])
                        best = whole if best is None else min(best, whole)
                known = ahead.get(far)
                if known is None or label < known:
                    ahead[far] = label
                    if known is None or label[0] < known[0]:
                        heappush(heap_a, (label[0], place, after))
        else:
            cost, gone, state = heappop(heap_b)
            at = n - gone
            node = 4 * at + state
            if node in done_b or back[node][0] < cost:
                continue
            done_b.add(node)
            audit = back[node][1]
            if at == 0 and state == start and (best is None or (cost, audit) < best):
                best = cost, audit
            steps = [(e, c, at, s) for e, c, s in ADD_BACK[state]]
            if at > 0:
                steps += [(e, c, at - 1, s) for e, c, s in CONSUME_BACK[turns[at - 1]][state]]
            for edit, more, place, before in steps:
                far, label = 4 * place + before, (cost + more, edit + audit)
                if far in done_a:
                    first = ahead[far]
                    if best is None or first[0] + label[0] <= best[0]:
                        whole = (first[0] + label[0], first[1] + label[1])
                        best = whole if best is None else min(best, whole)
                known = back.get(far)
                if known is None or label < known:
                    back[far] = label
                    if known is None or label[0] < known[0]:
                        heappush(heap_b, (label[0], n - place, before))
    return best


@lru_cache(maxsize=1 << 15)
def _short(turns: bytes) -> tuple[int, str]:
    return cheapest(turns, EMPTY, FINAL)


def repair(turns: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation; short ones that recur are searched once."""
    return _short(turns) if len(turns) <= 64 else cheapest(turns, EMPTY, FINAL)


def crossings(turns: bytes) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a part of a conversation, where one leads to the other."""
    found = ((a, b, cheapest(turns, a, (b,))) for a in range(4) for b in range(4))
    return [(a, b, *way) for a, b, way in found if way is not None]


def joined(ways: dict[int, tuple[int, str]], part: list[tuple[int, int, int, str]]) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) per state after one more part.

    Of equal costs into a state the least audit stays least whatever follows: both consume
    the same turns, so neither is the start of the other.
    """
    out: dict[int, tuple[int, str]] = {}
    for a, b, cost, audit in part:
        if a in ways:
            way = (ways[a][0] + cost, ways[a][1] + audit)
            out[b] = min(out.get(b, way), way)
    return out
