"""Gradient-boosted trees on binned features with missing values, grown leaf by leaf.

Features are cut into at most 255 bins at quantiles of the training rows; bin 0 is for
missing values, and every split learns on which side these go. A tree grows by the leaf
with the largest gain until it has ``leaves`` of them. One pass over the rows sums
gradients and hessians per (leaf, feature, bin) in each task and finds the best split of
each leaf from the sums of all tasks; the driver only sees one split per leaf. A pass serves
all leaves that may be needed, and all labels that are fitted, so a tree takes about as many
passes as it is deep, not one per split.

Where the rows fit in the memory of a task (``ALONE``), one task a label fits the whole model
from them and no pass is made; the trees are the same. What follows is for more rows.

Rows carry their running margins. These are written anew every ``keep`` rounds, and the few
trees since then are applied in passing. The margins of those rounds also give the AUC on
the validation rows, so that fitting ends by patience without fitting anything twice.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import cleaned_up, discard, materialize
from . import metrics

#: Values a bin number can take; 0 means missing.
BINS = 256
#: Rows a task sums up, about, and rows of a leaf that one task grows to the end.
TASK, HELD = 250_000, 2_000_000
#: Rows of a leaf from which sums of a child are taken as a difference.
LARGE = 16_384
#: Bins of training and validation rows from which one task fits a whole model; it holds about ten bytes for each.
ALONE = 48_000_000


@dataclass(frozen=True)
class Boosting:
    rounds: int = 500
    leaves: int = 31
    depth: int = 10
    step: float = 0.1
    bins: int = 255
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    # rounds without a better validation AUC after which boosting ends
    patience: int = 30
    # rounds after which margins are written and judged
    keep: int = 10


def _goes_left(x: np.ndarray, cut: int, missing_left: bool) -> np.ndarray:
    return x <= cut if missing_left else x - np.uint8(1) < cut  # where a bin of 0 becomes the largest


@dataclass
class Tree:
    """Nodes in lists; a leaf has feature -1. Rows with bin <= cut, and missing ones if so learned, go left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", 0), ("right", 0), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.value) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row; a node's rows are parted once, so a row costs as much as it is deep."""
        out, todo = np.zeros(len(bins), np.int64), [(0, np.arange(len(bins)))]
        while todo:
            node, at = todo.pop()
            if self.feature[node] < 0:
                out[at] = node
            elif len(at):
                left = _goes_left(bins[:, self.feature[node]].take(at), self.cut[node], self.missing_left[node])
                todo += [(self.left[node], at.compress(left)), (self.right[node], at.compress(~left))]
        return out

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model; ``quality`` has the validation AUC of every round that was fitted."""

    cuts: tuple[np.ndarray, ...]
    prior: float
    trees: tuple[Tree, ...]
    quality: dict[int, float | None]

    def probability(self, features: Column) -> Column:
        """Of the positive class, for an array of raw features in which NULL means missing."""

        def score(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype="float64")
            bins = binned(np.stack(rows.to_numpy()).astype(np.float64), self.cuts)
            margin = self.prior + sum((t.margin(bins) for t in self.trees), np.zeros(len(bins)))
            return pd.Series(1 / (1 + np.exp(-margin)))

        return F.pandas_udf(score, "double")(features)

    def gains(self) -> np.ndarray:
        out = np.zeros(len(self.cuts))
        for t in self.trees:
            for k, g in zip(t.feature, t.gain):
                if k >= 0:
                    out[k] += g
        return out


def cut_points(train: DataFrame, features: str, n: int, bins: int) -> tuple[np.ndarray, ...]:
    """Upper ends of the bins of every feature: different quantiles, with a rank error of a tenth of a bin."""
    columns = [f"f{k}" for k in range(n)]
    rows = train.select(*[F.get(F.col(features), F.lit(k)).cast("double").alias(c) for k, c in enumerate(columns)])
    found = rows.approxQuantile(columns, [k / (bins - 1) for k in range(1, bins - 1)], 0.1 / bins)
    return tuple(np.unique(np.array(x, np.float64)) for x in found)


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix in which NaN means missing."""
    out = np.zeros(x.shape, np.uint8)
    for k, ends in enumerate(cuts):
        out[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(ends, x[:, k]) + 1)
    return out


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _bytes(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


class _Growing:
    """A tree whose leaves get their best splits as passes find them."""

    def __init__(self, b: Boosting, size: float = 0):
        self.b, self.tree = b, Tree()
        self.tree.add(0.0)
        self.depth, self.size = [0], [size]
        # per node its best split as found, None where there is none
        self.split: dict[int, dict | None] = {}

    def put(self, found: dict) -> None:
        node, t = found["node"], self.tree
        if node == 0:
            t.value[0] = self._value(found["g"], found["h"])
        if found["feature"] < 0 or found["gain"] <= 0:
            self.split[node] = None
            return
        self.split[node] = found
        for side in ("left", "right"):
            g, h, n = found[f"{side}_g"], found[f"{side}_h"], found[f"{side}_n"]
            child = t.add(self._value(g, h))
            found[side] = child
            self.depth.append(self.depth[node] + 1)
            self.size.append(n)
            if self.depth[child] >= self.b.depth or n < 2 * self.b.min_rows:
                self.split[child] = None
        # routes rows to the children; undone for those that do not stay
        t.feature[node], t.cut[node], t.missing_left[node] = found["feature"], found["cut"], found["missing_left"]
        t.left[node], t.right[node], t.gain[node] = found["left"], found["right"], found["gain"]

    def _value(self, g: float, h: float) -> float:
        return -self.b.step * g / max(h + self.b.l2, 1e-12)

    def _best_first(self) -> tuple[list[int], list[int]]:
        """Nodes that are split in order of gain as far as is known, and the leaves whose splits must be known."""
        if 0 not in self.split:
            return [], [0]
        heap, done, open_, before = [], [], [], 0

        def leaf(node):
            if node not in self.split:
                open_.append(node)
            elif self.split[node] is not None:
                heapq.heappush(heap, (-self.split[node]["gain"], node))

        leaf(0)
        while heap and len(done) + 1 < self.b.leaves:
            before = len(open_)
            node = heapq.heappop(heap)[1]
            done.append(node)
            leaf(self.split[node]["left"])
            leaf(self.split[node]["right"])
        if len(done) + 1 >= self.b.leaves:
            del open_[before:]  # the last split's leaves stay leaves
        return done, open_

    def wanted(self) -> list[int]:
        return self._best_first()[1]

    def finished(self) -> Tree:
        """The tree of the splits in order of gain, its nodes numbered anew."""
        kept, old, out = set(self._best_first()[0]), self.tree, Tree()

        def copy(node: int) -> int:
            n = out.add(old.value[node])
            if node in kept:
                out.feature[n], out.cut[n], out.missing_left[n], out.gain[n] = (
                    old.feature[node], old.cut[node], old.missing_left[node], old.gain[node]
                )
                out.left[n], out.right[n] = copy(old.left[node]), copy(old.right[node])
            return n

        copy(0)
        return out


def best_split(sums: np.ndarray, b: Boosting) -> dict:
    """The best split for sums (feature, bin, gradient/hessian/rows); feature -1 if there is none.

    Of equal gains the first feature, then the smallest cut, then missing values to the right.
    """
    total = sums[0].sum(axis=0)
    seen = np.cumsum(sums[:, 1:], axis=1)
    left = np.stack([seen, seen + sums[:, :1]], axis=2)  # missing right, missing left
    right = total - left
    fits = (np.minimum(left[..., 2], right[..., 2]) >= b.min_rows) & (np.minimum(left[..., 1], right[..., 1]) >= b.min_hessian)

    def score(x):
        return x[..., 0] ** 2 / np.maximum(x[..., 1] + b.l2, 1e-12)

    gain = np.where(fits, score(left) + score(right) - score(total), -np.inf)
    at = int(np.argmax(gain))
    feature, cut, missing_left = np.unravel_index(at, gain.shape)
    found = {"g": total[0], "h": total[1], "feature": -1, "cut": 0, "missing_left": False, "gain": 0.0}
    l, r = (left[feature, cut, missing_left], right[feature, cut, missing_left])
    if np.isfinite(gain.flat[at]):
        found |= {"feature": int(feature), "cut": int(cut) + 1, "missing_left": bool(missing_left), "gain": float(gain.flat[at])}
    return found | {f"{side}_{c}": x for side, s in (("left", l), ("right", r)) for c, x in zip("ghn", s)}


FOUND = (
    "feature long, cut long, missing_left boolean, gain double, g double, h double, "
    "left_g double, left_h double, left_n double, right_g double, right_h double, right_n double"
)
SPLIT = f"label long, node long, {FOUND}"
#: Splits of a subtree: nodes are numbered within it, 0 is the leaf it hangs from.
GROWN = f"label long, node long, own long, own_left long, own_right long, {FOUND}"


def _margins(batch: pa.RecordBatch, bins: np.ndarray, fresh: dict[int, list[Tree]], n_labels: int) -> np.ndarray:
    out = _matrix(batch.column("m"), n_labels).copy()
    for k, trees in fresh.items():
        for t in trees:
            out[:, k] += t.margin(bins)
    return out


def _add(total: np.ndarray, slot: np.ndarray, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Add rows to sums (slot, feature, bin, gradient/hessian/rows)."""
    for f in range(total.shape[1]):
        key = slot * BINS + bins[:, f]
        for c, weight in enumerate((g, h, None)):
            total[:, f, :, c] += np.bincount(key, weight, len(total) * BINS).reshape(-1, BINS)


class _Rows:
    """Which rows are in a node of a growing tree, as far as asked; ``cols`` has a row of bins per feature.

    Of two children with more than ``large`` rows together the larger one's sums are those of
    their parent less those of the other. Smaller ones are summed up row by row.
    """

    def __init__(self, cols: np.ndarray, g: np.ndarray, h: np.ndarray, growing: _Growing, large: int):
        self.cols, self.g, self.h, self.growing, self.large = cols, g, h, growing, large
        self.known: dict[int, np.ndarray] = {0: np.arange(cols.shape[1], dtype=np.int32)}
        self.total: dict[int, np.ndarray] = {}
        self.above: dict[int, int] = {}

    def of(self, node: int) -> np.ndarray:
        if node not in self.known:
            self.of(above := self.above[node])
            at, found = self.known.pop(above), self.growing.split[above]
            left = _goes_left(self.cols[found["feature"]].take(at), found["cut"], found["missing_left"])
            self.known[found["left"]], self.known[found["right"]] = at.compress(left), at.compress(~left)
        return self.known[node]

    def sums(self, node: int) -> np.ndarray:
        """Sums (feature, bin, gradient/hessian/rows) of a leaf."""
        if node in self.total:
            return self.total[node]
        above = self.total.get(self.above.get(node, -1))
        if above is not None:
            split = self.growing.split[self.above[node]]
            other = split["left"] + split["right"] - node
            if len(self.of(other)) < len(self.of(node)):
                total = above - self.sums(other)
                total[total[:, :, 2] == 0] = 0  # as sums over no rows are
                return self._kept(node, total)
        at = self.of(node)
        g, h, total = self.g.take(at), self.h.take(at), np.empty((len(self.cols), BINS, 3))
        for f, col in enumerate(self.cols):
            key = col.take(at).astype(np.intp)
            for c, weight in enumerate((g, h, None)):
                total[f, :, c] = np.bincount(key, weight, BINS)
        return self._kept(node, total)

    def _kept(self, node: int, total: np.ndarray) -> np.ndarray:
        if len(self.of(node)) > self.large or self.above.get(node) in self.total:
            self.total[node] = total
        return total

    def split(self, node: int) -> dict:
        """Hand the best split of a leaf to the tree. The split, and the places of its children, -1 where there is none."""
        found = best_split(self.sums(node), self.growing.b)
        if len(self.of(node)) <= self.large:
            self.total.pop(node, None)
        self.growing.put(found | {"node": node})
        own = self.growing.split[node]
        if own:
            self.above[own["left"]] = self.above[own["right"]] = node
        return found | {"own": node, "own_left": own["left"] if own else -1, "own_right": own["right"] if own else -1}


def grown(bins: np.ndarray, g: np.ndarray, h: np.ndarray, b: Boosting) -> list[dict]:
    """All splits below a leaf that may be needed, from its rows: the first ``leaves`` - 1 by gain."""
    growing, out = _Growing(b), []
    rows = _Rows(np.ascontiguousarray(bins.T), g, h, growing, LARGE)
    while wanted := growing.wanted():
        out += [rows.split(node) for node in wanted]
    return out


def area(y: np.ndarray, score: np.ndarray) -> float | None:
    """ROC-AUC, ties count half; None when a class is missing."""
    order = np.argsort(score)
    ends = np.flatnonzero(np.append(np.diff(score[order]) != 0, True)) if len(order) else np.zeros(0, int)
    pos = np.diff(np.cumsum(y[order].astype(np.int64))[ends], prepend=0)
    neg = np.diff(ends + 1, prepend=0) - pos
    if not (pos.sum() and neg.sum()):
        return None
    return float((pos * (np.cumsum(neg) - neg + neg / 2)).sum()) / (int(pos.sum()) * int(neg.sum()))


def fitted(train: tuple[np.ndarray, np.ndarray], val: tuple[np.ndarray, np.ndarray], prior: float, b: Boosting) -> tuple[list[Tree], dict[int, float | None]]:
    """All trees until patience or rounds run out, and the validation AUC of each, from columns of bins and labels."""
    margins = [np.full(len(y), prior) for _, y in (train, val)]
    trees: list[Tree] = []
    quality: dict[int, float | None] = {}
    while len(trees) < b.rounds:
        for _ in range(min(b.keep, b.rounds - len(trees))):
            p = 1 / (1 + np.exp(-margins[0]))
            g, h = p - train[1], p * (1 - p)
            del p
            growing = _Growing(b, len(g))
            rows = _Rows(train[0], g, h, growing, LARGE)
            while wanted := growing.wanted():
                for node in wanted:
                    rows.split(node)
            trees.append(growing.finished())
            del rows
            for (cols, _), margin in zip((train, val), margins):
                margin += trees[-1].margin(cols.T)
            quality[len(trees)] = area(val[1], margins[1])
        if best_round(quality, b.patience)[1]:
            break
    return trees, quality


def _alone(rows: DataFrame, n: int, active: Sequence[int], prior: Sequence[float], n_labels: int, b: Boosting) -> dict[int, tuple[list[Tree], dict[int, float | None]]]:
    """Trees and quality of every label, each fitted by one task."""

    def of(k: int) -> DataFrame:
        def run(batches):
            parts = {"train": [], "val": []}
            for batch in batches:
                bins, y = _bytes(batch.column("bins"), n), _matrix(batch.column("y"), n_labels)[:, k]
                split = np.array(batch.column("split").to_pylist(), object)
                for name, into in parts.items():
                    at = np.flatnonzero((split == name) & ~np.isnan(y))
                    into.append((np.ascontiguousarray(bins[at].T), y[at].astype(np.uint8)))
            whole = {}
            for name in list(parts):
                into = parts.pop(name)
                cols, y = ([x[c] for x in into] for c in (0, 1))
                whole[name] = (np.concatenate(cols, axis=1), np.concatenate(y)) if into else (np.zeros((n, 0), np.uint8), np.zeros(0, np.uint8))
            trees, quality = fitted(whole["train"], whole["val"], prior[k], b)
            said = json.dumps([[asdict(t) for t in trees], list(quality.items())], default=lambda x: x.item())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([said])], ["label", "model"])

        return rows.select("split", "bins", "y").coalesce(1).mapInArrow(run, "label int, model string")

    out = {}
    for r in reduce(DataFrame.unionByName, [of(k) for k in active]).collect():
        trees, quality = json.loads(r["model"])
        out[r["label"]] = [Tree(**t) for t in trees], dict(map(tuple, quality))
    return out


def _passed(rows: DataFrame, growing: dict[int, _Growing], fresh: dict[int, list[Tree]], n: int, n_labels: int, b: Boosting) -> None:
    """One pass: the best split of every wanted leaf, and of all below those that are small."""
    wanted = [(k, node) for k, g in growing.items() for node in g.wanted()]
    small = {(k, node) for k, node in wanted if growing[k].size[node] <= HELD}
    trees = {k: g.tree for k, g in growing.items()}
    depth = {(k, node): growing[k].depth[node] for k, node in small}
    large = [x for x in wanted if x not in small]

    def placed(batches, leaves):
        """Per batch and label the rows in these leaves: place of the leaf, bins, gradient and hessian."""
        for batch in batches:
            bins, y = _bytes(batch.column("bins"), n), _matrix(batch.column("y"), n_labels)
            margin = _margins(batch, bins, fresh, n_labels)
            for k, tree in trees.items():
                slot = np.full(len(tree.value), -1)
                for place, (label, node) in enumerate(leaves):
                    if label == k:
                        slot[node] = place
                slot = slot[tree.leaf_of(bins)]
                known = np.flatnonzero((slot >= 0) & ~np.isnan(y[:, k]))
                p = 1 / (1 + np.exp(-margin[known, k]))
                yield batch, known, slot[known], bins[known], p - y[known, k], p * (1 - p)

    def sums(batches):
        total = np.zeros((len(large), n, BINS, 3))
        for _, _, slot, bins, g, h in placed(batches, large):
            _add(total, slot, bins, g, h)
        some = [(k, node, total[place].tobytes()) for place, (k, node) in enumerate(large) if total[place, 0, :, 2].any()]
        columns = zip(("label", "node", "sums"), (pa.int32(), pa.int32(), pa.binary()), zip(*some) if some else ((), (), ()))
        yield pa.RecordBatch.from_pydict({c: pa.array(list(x), t) for c, t, x in columns})

    def split(table: pa.Table) -> pa.Table:
        total = np.zeros((n, BINS, 3))
        for part in table.column("sums"):
            total += np.frombuffer(part.as_buffer(), np.float64).reshape(total.shape)
        head = {c: table.column(c)[0].as_py() for c in ("label", "node")}
        return pa.Table.from_pylist([head | best_split(total, b)])

    leaves = sorted(small)

    def handed(batches):
        for batch, known, slot, _, g, h in placed(batches, leaves):
            of = np.array(leaves, np.int32)[slot]
            columns = [pa.array(of[:, 0]), pa.array(of[:, 1]), batch.column("bins").take(pa.array(known)), pa.array(g), pa.array(h)]
            yield pa.RecordBatch.from_arrays(columns, ["label", "node", "bins", "g", "h"])

    def grow(table: pa.Table) -> pa.Table:
        head = {c: table.column(c)[0].as_py() for c in ("label", "node")}
        own = replace(b, depth=b.depth - depth[head["label"], head["node"]])
        bins = _bytes(table.column("bins").combine_chunks(), n)
        found = grown(bins, table.column("g").to_numpy(), table.column("h").to_numpy(), own)
        return pa.Table.from_pylist([head | f for f in found])

    train = rows.filter("split = 'train'").select("bins", "y", "m")
    if large:
        partial = train.mapInArrow(sums, "label int, node int, sums binary")
        for r in partial.groupBy("label", "node").applyInArrow(split, SPLIT).collect():
            growing[r["label"]].put(r.asDict())
    if small:
        held = train.mapInArrow(handed, "label int, node int, bins binary, g double, h double")
        found = held.groupBy("label", "node").applyInArrow(grow, GROWN).collect()
        number = {(k, node, 0): node for k, node in leaves}
        for r in sorted(found, key=lambda r: (r["label"], r["node"], r["own"])):
            k, top = r["label"], (r["label"], r["node"])
            node = number[*top, r["own"]]
            growing[k].put(r.asDict() | {"node": node})
            if made := growing[k].split[node]:
                number[*top, r["own_left"]], number[*top, r["own_right"]] = made["left"], made["right"]
    for k, node in wanted:
        growing[k].split.setdefault(node, None)  # no rows


def best_round(quality: dict[int, float | None], patience: int) -> tuple[int, bool]:
    """The round to keep, and whether patience ran out after it. Ties keep the earlier round."""
    best, top = 0, float("-inf")
    for n in sorted(quality):
        if quality[n] is not None and quality[n] > top:
            best, top = n, quality[n]
        elif n - best >= patience:
            return max(best, 1), True
    return max(best, 1), False


def _judged(rows: DataFrame, fresh: dict[int, list[Tree]], n: int, n_labels: int, after: int) -> dict[int, dict[int, float | None]]:
    """Validation AUC of every label after each of the fresh trees, by number of trees."""

    def each(batches):
        for batch in batches:
            bins, y = _bytes(batch.column("bins"), n), _matrix(batch.column("y"), n_labels)
            before = _matrix(batch.column("m"), n_labels)
            for k, trees in fresh.items():
                margin, known = before[:, k].copy(), ~np.isnan(y[:, k])
                for turn, t in enumerate(trees, after + 1):
                    margin += t.margin(bins)
                    size = int(known.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, k, np.int32)), pa.array(np.full(size, turn, np.int32)), pa.array(y[known, k].astype(np.int32)), pa.array(margin[known])],
                        ["label", "round", "y", "score"],
                    )

    val = rows.filter("split = 'val'").select("bins", "y", "m")
    scored = val.mapInArrow(each, "label int, round int, y int, score double")
    out: dict[int, dict[int, float | None]] = {k: {after + 1 + i: None for i in range(len(t))} for k, t in fresh.items()}
    for r in metrics.ranking_quality(scored, ["label", "round"]).collect():
        out[r["label"]][r["round"]] = r["roc_auc"]
    return out


def fit(frame: DataFrame, features: str, n: int, labels: Sequence[str], b: Boosting) -> dict[str, BoostedTrees]:
    """One model per label on the rows with split 'train', kept up to the round with the best AUC on 'val'.

    ``features`` names an array of ``n`` raw values; rows without a label do not count for
    it. Fitting ends when every label has gone ``patience`` rounds without a better AUC.
    Validation rows without both classes leave one round. A label without both classes in
    training has no trees, and one without training rows a probability of a half.
    """
    used = frame.filter("split in ('train', 'val')")
    train = used.filter("split = 'train'")
    cuts = cut_points(train, features, n, b.bins)
    found = train.agg(
        F.count(F.lit(1)), *[F.count(c) for c in labels], *[F.avg(F.col(c).cast("double")) for c in labels]
    ).first()
    tasks, known, rates = math.ceil(found[0] / TASK) or 1, found[1 : len(labels) + 1], found[len(labels) + 1 :]
    prior = []
    for p in rates:
        prior.append(0.0 if p is None else math.log(max(p, 1e-15) / max(1 - p, 1e-15)))

    def cut(batches):
        for batch in batches:
            bins = binned(_matrix(batch.column("x"), n), cuts)
            data = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("split"), data, batch.column("y"), batch.column("m")], ["split", "bins", "y", "m"])

    raw = used.select(
        "split",
        F.col(features).alias("x"),
        F.array(*[F.col(c).cast("double") for c in labels]).alias("y"),
        F.array(*[F.lit(x) for x in prior]).alias("m"),
    )
    schema = "split string, bins binary, y array<double>, m array<double>"
    written = materialize(raw.mapInArrow(cut, schema))
    rows = written.coalesce(tasks)

    trees: dict[int, list[Tree]] = {k: [] for k in range(len(labels))}
    quality: dict[int, dict[int, float | None]] = {k: {} for k in trees}
    active = [k for k, p in enumerate(rates) if p is not None and 0 < p < 1]
    turn = 0
    if active and rows.count() * n <= ALONE:
        for k, (found, judged) in _alone(rows, n, active, prior, len(labels), b).items():
            trees[k], quality[k] = found, judged
        active = []
    while active and turn < b.rounds:
        fresh: dict[int, list[Tree]] = {k: [] for k in active}
        for _ in range(min(b.keep, b.rounds - turn)):
            growing = {k: _Growing(b, known[k]) for k in active}
            while any(g.wanted() for g in growing.values()):
                with cleaned_up(frame.sparkSession):
                    _passed(rows, growing, fresh, n, len(labels), b)
            for k, g in growing.items():
                fresh[k].append(g.finished())
        for k, found in _judged(rows, fresh, n, len(labels), turn).items():
            quality[k] |= found
            trees[k] += fresh[k]
        turn += len(next(iter(fresh.values())))
        active = [k for k in active if not best_round(quality[k], b.patience)[1]]
        if active and turn < b.rounds:

            def add(batches, fresh=fresh):
                for batch in batches:
                    m = _margins(batch, _bytes(batch.column("bins"), n), fresh, len(labels))
                    ends = pa.array(np.arange(0, m.size + 1, len(labels)), pa.int32())
                    columns = [batch.column(c) for c in ("split", "bins", "y")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], ["split", "bins", "y", "m"])

            old, written = written, materialize(rows.mapInArrow(add, schema))
            discard(old)
            rows = written.coalesce(tasks)
    discard(written)
    out = {}
    for k, c in enumerate(labels):
        kept = trees[k][: best_round(quality[k], b.patience)[0]] if trees[k] else []
        out[c] = BoostedTrees(cuts, prior[k], tuple(kept), quality[k])
    return out

