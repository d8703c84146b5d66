"""Boosted trees with patience: many models in one grouped fit.

A search or a leave-one-year-out run fits dozens of models to parts of the same rows.
Here all of them grow side by side, and one level of one round is one pass over the rows:
each task adds up gradient and curvature by (model, node, feature, bin), the sums of a
(model, node) meet in a shuffle, and its best split is found where they meet.  The driver
sees splits only, so a pass costs about the same for one model as for a hundred.
Where the rows are few (``ALONE_ROWS``; a coarse grid's cells), the start of a pass costs
more than the pass: there a task grows one model to its end from a broadcast of the rows,
with the same functions and the same result, and any number of rounds is one job.

* A model fits the rows its split marks with 1, watches those marked 2 and leaves out the
  rest.  It ends when the watched loss has not improved by more than ``least_improvement`` within
  ``patience`` rounds and keeps the rounds up to the best one; without watched rows it runs all rounds.
* Newton steps with L1 and L2 penalties on leaves, least gain and least curvature of a
  child, drawn rows and columns for each tree; the first tree is the base rate.
* Missing values go right.  Categories are ordered by their gradient in each node.

Scale: rows become blocks of bytes (one a bin, 15 a row) with a margin of four bytes a
model, kept in memory and disk and written to the shared folder every ``KEEP_EVERY`` rounds,
so a lost executor costs at most so many rounds of its own blocks.  A task's sums are
bounded by models x nodes x bins, a reducer's by its part of them.  Gradients
are rounded to 2^-20, so sums are exact and, with equal cuts, a fit does not depend on
how rows are dealt.  Cuts come from one sketch over all rows.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinder.operators.models import B1_CATEGORIES
from cinder.operators.trees import Forest, matrix
from cinder.schema import CATEGORICAL, FEATURES
from cinder.session import cut_lineage

BINS = 32              # of a numeric feature
ROUNDS = 3000
PATIENCE = 200
KEEP_EVERY = 20
ALONE_ROWS = 1 << 17   # up to so many rows (36 bytes each) a task fits a whole model
LEAST_IMPROVEMENT = 1e-6
_UNIT = float(1 << 20)
_TOGETHER = 256        # sums sent in one batch
_WIDTH = max(BINS + 1, len(B1_CATEGORIES) + 1)
# Functions that run in tasks travel with the job: executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Spec:
    """One model of a grouped fit."""
    split: str                     # column: 1 fits the row, 2 watches it, anything else leaves it out
    depth: int = 4
    step: float = 0.1
    least_weight: float = 1.0      # curvature of a child
    least_gain: float = 0.0
    rows: float = 1.0              # share drawn for each tree
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    positive_weight: float = 1.0   # of rows with a label above 0
    squared: bool = False          # squared error, else logistic loss


@dataclass
class Fitted:
    forest: Forest
    rounds: int                    # kept: up to the least watched loss
    losses: list[float] = field(default_factory=list)   # watched loss before the first and after each round


@dataclass
class _Tree:
    """A tree of one round as a heap: the children of i are 2i + 1 and 2i + 2."""
    feature: np.ndarray            # -1 in leaves
    left: np.ndarray               # node x bin: which bins go left
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> _Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros((n, _WIDTH), bool), np.zeros(n))

    def grow(self, s: Spec, node: int, feature: int, bins, g: float, h: float, gl: float, hl: float) -> bool:
        """Split a node if a feature was found; whether it was."""
        if node == 0:
            self.value[0] = _leaf(g, h, s)
        if feature < 0:
            return False
        self.feature[node] = feature
        self.left[node, bins] = True
        self.value[2 * node + 1] = _leaf(gl, hl, s)
        self.value[2 * node + 2] = _leaf(g - gl, h - hl, s)
        return True

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row has come to."""
        at = np.zeros(len(bins), int)
        while True:
            f = self.feature[at]
            if not (f >= 0).any():
                return at
            go = self.left[at, bins[np.arange(len(bins)), np.maximum(f, 0)]]
            at = np.where(f >= 0, 2 * at + np.where(go, 1, 2), at)


def _names(features: Sequence[str]) -> list[str]:
    return [f for f in features if f not in CATEGORICAL] + [f for f in features if f in CATEGORICAL]


def _cuts(df: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Cut values of each numeric feature (the greatest value is one); none for categories."""
    probs = [i / BINS for i in range(1, BINS + 1)]
    numeric = [n for n in names if n not in CATEGORICAL]
    value = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    got = df.select(*[F.percentile_approx(value(n), probs).alias(n) for n in numeric]).first() if numeric else {}
    return [np.unique(np.array(got[n] or [], float)) if n in numeric else np.zeros(0) for n in names]


def _blocks(df: DataFrame, label: str, splits: Sequence[str], key_cols: Sequence[str],
            names: Sequence[str], cuts: Sequence[np.ndarray], base: np.ndarray) -> DataFrame:
    """Rows as blocks: an Arrow batch of rows is one row of byte strings."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = matrix({n: b[n] for n in names}, names)
            bins = np.stack([np.searchsorted(c, x[:, j]) if n not in CATEGORICAL else x[:, j]
                             for j, (n, c) in enumerate(zip(names, cuts))], axis=1).astype(np.uint8)
            yield pd.DataFrame({"n": [len(b)], "bins": [bins.tobytes()], "y": [b["_y"].to_numpy(float).tobytes()],
                                "roles": [b[list(splits)].to_numpy(np.int8).tobytes()],
                                "draw": [b["_h"].to_numpy(np.int64).tobytes()],
                                "margin": [np.tile(base.astype(np.float32), (len(b), 1)).tobytes()]})

    role = lambda s: F.coalesce(F.when(F.col(s).isin(1, 2), F.col(s)), F.lit(0)).cast("tinyint").alias(s)
    cols = [F.col(n).cast("double").alias(n) for n in names]
    rows = df.where(F.col(label).isNotNull()).select(
        *cols, *[role(s) for s in splits], F.col(label).cast("double").alias("_y"), F.xxhash64(*key_cols).alias("_h"))
    return rows.mapInPandas(pack, "n int, bins binary, y binary, roles binary, draw binary, margin binary")


@dataclass
class _Block:
    bins: np.ndarray
    y: np.ndarray
    roles: np.ndarray
    draw: np.ndarray
    margin: np.ndarray

    @classmethod
    def read(cls, r) -> _Block:
        of = lambda b, kind: np.frombuffer(b, kind).reshape(r.n, -1)
        margin = of(r.margin, np.float32) if hasattr(r, "margin") else np.zeros((r.n, 0), np.float32)
        return cls(of(r.bins, np.uint8), of(r.y, float)[:, 0], of(r.roles, np.int8), of(r.draw, np.uint64)[:, 0], margin)

    def drawn(self, share: float, seed: int) -> np.ndarray:
        """A fixed draw of the rows by their keys."""
        if share >= 1:
            return np.ones(len(self.y), bool)
        z = self.draw + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) < np.uint64(int(share * ((1 << 64) - 1)))


def _places(categorical: Sequence[bool]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) of each place in the sums of a node: a numeric feature has fewer bins than a category codes."""
    n = np.where(categorical, _WIDTH, BINS + 1)
    return np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(0), *map(np.arange, n)])


def _watched(b: _Block, s: Spec, role: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Loss and weight of the watched rows at margins ``f``."""
    on = role == 2
    w = np.where(b.y[on] > 0, s.positive_weight, 1.0)
    loss = (b.y[on] - f[on]) ** 2 if s.squared else np.logaddexp(0, f[on]) - b.y[on] * f[on]
    return np.array([np.rint(w * loss * _UNIT).sum(), np.rint(w * _UNIT).sum()])


def _drawn(b: _Block, s: Spec, role: np.ndarray, f: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gradient, curvature) of the rows that a tree draws."""
    on = np.flatnonzero((role == 1) & b.drawn(s.rows, seed))
    w = np.where(b.y[on] > 0, s.positive_weight, 1.0)
    p = f[on] if s.squared else 1 / (1 + np.exp(-f[on]))
    return on, np.rint(w * (p - b.y[on]) * _UNIT), np.rint(w * (1.0 if s.squared else p * (1 - p)) * _UNIT)


def _by_node(b: _Block, code: np.ndarray, tree: _Tree, level: int, width: int, on: np.ndarray, g: np.ndarray,
             h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node of this level, sums of gradient and curvature by place) of drawn rows."""
    at = tree.nodes(b.bins[on])
    first = (1 << level) - 1
    keep = at >= first                                       # rows whose node is of this level
    on, g, h, at = on[keep], g[keep], h[keep], at[keep] - first
    if not len(on):
        return
    slot = (code[on] + at[:, None] * width).ravel()
    n = width << level
    both = np.stack([np.bincount(slot, np.repeat(v, b.bins.shape[1]), n).reshape(-1, width) for v in (g, h)], axis=1)
    for node in np.unique(at):
        yield first + int(node), both[node]


def _sums(specs: Sequence[Spec], categorical: Sequence[bool], place: Sequence[int], live: dict[int, _Tree], level: int, round_: int, watch: bool):
    """The task's part of one level: gradient and curvature by (model, node), and with
    ``watch`` the loss of watched rows as node -1."""
    feature, _ = _places(categorical)
    first_of, width = np.searchsorted(feature, np.arange(len(categorical))), len(feature)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                b = _Block.read(r)
                code = b.bins + first_of
                for m, tree in live.items():
                    s, role, f = specs[m], b.roles[:, place[m]], b.margin[:, m].astype(float)
                    if watch and (role == 2).any():
                        total[m, -1] = total.get((m, -1), 0) + _watched(b, s, role, f)
                    drawn = _drawn(b, s, role, f, round_ * len(specs) + m + 1)
                    for node, v in _by_node(b, code, tree, level, width, *drawn):
                        total[m, node] = total.get((m, node), 0) + v
        done = [(m, node, v.tobytes()) for (m, node), v in total.items()]
        for i in range(0, len(done), _TOGETHER):
            yield pd.DataFrame(done[i:i + _TOGETHER], columns=["model", "node", "sums"])
    return add


def _soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _worth(g, h, s: Spec):
    return _soft(g, s.l1) ** 2 / np.maximum(h + s.l2, 1e-12)


def _leaf(g: float, h: float, s: Spec) -> float:
    return float(-s.step * _soft(g, s.l1) / max(h + s.l2, 1e-12))


def best_split(g: np.ndarray, h: np.ndarray, s: Spec, categorical: Sequence[bool], open_: Sequence[int]):
    """(feature, bins that go left, left sums) of the split with the greatest gain, or None;
    ties go to the first feature and the fewest bins on the left."""
    def gains(gf, hf):
        gl, hl = np.cumsum(gf, axis=-1), np.cumsum(hf, axis=-1)
        gr, hr = gl[..., -1:] - gl, hl[..., -1:] - hl
        ok = (hl >= s.least_weight) & (hr >= s.least_weight) & (hl > 0) & (hr > 0)
        gain = (_worth(gl, hl, s) + _worth(gr, hr, s) - _worth(gl[..., -1:], hl[..., -1:], s)) / 2
        return np.where(ok, gain, -np.inf), gl, hl

    best, found = max(s.least_gain, 0.0) + 1e-9, None
    numeric = [f for f in open_ if not categorical[f]]
    if numeric:                                               # all at once: their bins keep their order
        every = gains(g[numeric, :BINS + 1], h[numeric, :BINS + 1])
    for f in open_:
        if categorical[f]:
            seen = np.flatnonzero(h[f] > 0)
            if not len(seen):
                continue
            order = seen[np.argsort(g[f][seen] / (h[f][seen] + s.l2), kind="stable")]
            gain, gl, hl = gains(g[f][order], h[f][order])
        else:
            order = np.arange(BINS + 1)
            gain, gl, hl = (v[numeric.index(f)] for v in every)
        i = int(gain.argmax())
        if gain[i] > best:
            best, found = float(gain[i]), (f, order[:i + 1], gl[i], hl[i])
    return found


def _split(s: Spec, categorical: Sequence[bool], places: tuple, seed: list[int], total: np.ndarray) -> tuple:
    """(feature or -1, bins that go left, sums of the node, sums on the left) from a node's sums."""
    d = len(categorical)
    both = np.zeros((2, d, _WIDTH))
    both[:, *places] = total.reshape(2, -1) / _UNIT
    g, h = both
    n = max(1, int(np.ceil(s.columns * d)))
    open_ = sorted(np.random.default_rng(seed).permutation(d)[:n].tolist())
    got = best_split(g, h, s, categorical, open_)
    f, left, gl, hl = got if got else (-1, None, 0.0, 0.0)
    return f, None if left is None else left.tolist(), float(g[0].sum()), float(h[0].sum()), float(gl), float(hl)


def _choose(specs: Sequence[Spec], categorical: Sequence[bool], round_: int):
    """The sums of each (model, node) of a partition added up, and their best splits."""
    places = _places(categorical)

    def split(m: int, node: int, total: np.ndarray) -> tuple:
        if node < 0:
            return m, node, -1, None, float(total[0] / total[1]) if total[1] else None, 0.0, 0.0, 0.0
        return m, node, *_split(specs[m], categorical, places, [round_, m], total)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for m, node, v in zip(b["model"], b["node"], b["sums"]):
                k = int(m), int(node)
                total[k] = total.get(k, 0) + np.frombuffer(v)
        if total:
            yield pd.DataFrame([split(*k, v) for k, v in total.items()], columns=["model", "node", "feature", "bins", "g", "h", "gl", "hl"])
    return choose


def _done(losses: list[float], patience: int, least: float) -> bool:
    return len(losses) > patience and min(losses[-patience:]) >= min(losses[:-patience]) - least


def _whole(specs: Sequence[Spec], categorical: Sequence[bool], place: Sequence[int], live: Sequence[int], base: np.ndarray, cuts: Sequence[np.ndarray],
           features: Sequence[str], shared, rounds: int, patience: int, least: float):
    """Whole models, each grown to its end by the task that has its number in ``live``: the
    rounds of the passes, on one block of all rows.  The driver gets the nodes that rows can reach."""
    places = _places(categorical)
    first_of, width = np.searchsorted(places[0], np.arange(len(categorical))), len(places[0])

    def grown(m: int, b: _Block) -> tuple[list[_Tree], list[float]]:
        s, role, code, trees, losses = specs[m], b.roles[:, place[m]], b.bins + first_of, [], []
        margin = np.full(len(b.y), base[m], np.float32)
        for r in range(rounds + 1):
            f = margin.astype(float)
            if (role == 2).any():
                loss, weight = _watched(b, s, role, f)
                if weight:
                    losses.append(float(loss / weight))
            if r == rounds or _done(losses, patience, least):
                break
            tree, drawn = _Tree.empty(s.depth), _drawn(b, s, role, f, r * len(specs) + m + 1)
            for level in range(s.depth):
                found = [(node, *_split(s, categorical, places, [r, m], v)) for node, v in _by_node(b, code, tree, level, width, *drawn)]
                if not any([tree.grow(s, *x) for x in found]):
                    break
            trees.append(tree)
            margin += tree.value[tree.nodes(b.bins)].astype(np.float32)
        return trees, losses

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = None
        for batch in batches:
            for i in batch["id"]:
                b = b or _Block(*[np.concatenate(part) for part in zip(*shared.value)], np.zeros(0))
                m = live[int(i)]
                trees, losses = grown(m, b)
                kept = _best(trees, losses)
                forest = _forest(trees[:kept], base[m], specs[m], cuts, features)
                yield pd.DataFrame({"model": [m], "fitted": [pickle.dumps((vars(forest), kept, np.array(losses)))]})
    return fit


def _best(trees: Sequence[_Tree], losses: Sequence[float]) -> int:
    """Rounds kept."""
    return int(np.argmin(losses)) if losses else len(trees)


def _moved(grown: dict[int, _Tree]):
    """Blocks with the margins after one more round."""
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                b = _Block.read(r)
                margin = b.margin.copy()
                for m, tree in grown.items():
                    margin[:, m] += tree.value[tree.nodes(b.bins)].astype(np.float32)
                out.append(margin.tobytes())
            yield batch.assign(margin=out)
    return move


def _forest(grown: Sequence[_Tree], base: float, s: Spec, cuts: Sequence[np.ndarray], features: Sequence[str]) -> Forest:
    names = _names(features)
    feature = np.concatenate([[-1], *[t.feature for t in grown]])
    value = np.concatenate([[base], *[t.value for t in grown]])
    goes = np.concatenate([np.zeros((1, _WIDTH), bool), *[t.left for t in grown]])
    heap = [1, *[len(t.feature) for t in grown]]
    within = np.concatenate([np.arange(n) for n in heap])
    start = np.repeat(np.cumsum([0, *heap[:-1]]), heap)
    met = within == 0                                        # nodes that rows can come to
    for i in range(1, max(heap)):
        child = np.flatnonzero(within == i)
        up = start[child] + (i - 1) // 2
        met[child] = met[up] & (feature[up] >= 0)
    to = np.cumsum(met) - 1
    feature, value, goes = feature[met], value[met], goes[met]
    down = np.where(feature >= 0, (start + 2 * within + 1)[met], 0)
    root = to[np.flatnonzero(within == 0)]
    own = np.arange(len(feature))
    kind = np.array([n in CATEGORICAL for n in names])
    tests = np.flatnonzero((feature >= 0) & kind[np.maximum(feature, 0)])
    category = np.full(len(feature), -1, np.int32)
    category[tests] = np.arange(len(tests))
    threshold = np.full(len(feature), np.inf)
    for i in np.flatnonzero((feature >= 0) & (category < 0)):
        threshold[i] = cuts[feature[i]][goes[i].sum() - 1]
    left_of = goes[tests] if len(tests) else np.zeros((1, 1), bool)
    left = np.where(feature >= 0, to[down], own)
    right = np.where(feature >= 0, to[np.minimum(down + 1, len(to) - 1)], own)
    return Forest(root, np.full(len(root), 1.0 if s.squared else 0.5), feature.astype(np.int16), threshold, category, left_of,
                  left.astype(np.int32), right.astype(np.int32), value,
                  not s.squared, tuple(features))


def fit_groups(df: DataFrame, label: str, specs: dict[str, Spec], key_cols: Sequence[str], features: Sequence[str] = tuple(FEATURES),
               rounds: int = ROUNDS, patience: int = PATIENCE,
               least_improvement: float = LEAST_IMPROVEMENT) -> dict[str, Fitted]:
    """All models of ``specs`` in one fit.  Labels are 0 or 1, or any number for ``squared``
    models; rows without a label are left out.  ``key_cols`` decide which rows a tree draws,
    so rows that repeat a key are drawn together.  A model without rows to fit is its base
    rate alone, 0.5 (or 0 for ``squared``) if there is none."""
    each, names = list(specs.values()), _names(features)
    splits = sorted({s.split for s in each})
    place = [splits.index(s.split) for s in each]
    categorical = [n in CATEGORICAL for n in names]
    y, labelled = F.col(label).cast("double"), df.where(F.col(label).isNotNull())
    cuts = _cuts(labelled, names)
    sizes = labelled.select(F.count(F.lit(1)).alias("rows"), *[a.alias(f"{k}{i}") for i, c in enumerate(splits) for k, a in (
        ("n", F.count_if(F.col(c) == 1)), ("p", F.count_if((F.col(c) == 1) & (y > 0))),
        ("s", F.sum(F.when((F.col(c) == 1) & (y > 0), y))), ("z", F.sum(F.when((F.col(c) == 1) & (y <= 0), y))))]).first()
    base = np.zeros(len(each))
    for m, (s, i) in enumerate(zip(each, place)):
        n, p = sizes[f"n{i}"], sizes[f"p{i}"]
        if n:
            weight = s.positive_weight * p + n - p
            mean = (s.positive_weight * (sizes[f"s{i}"] or 0.0) + (sizes[f"z{i}"] or 0.0)) / weight if weight else 0.5
            share = min(max(mean, 1e-6), 1 - 1e-6)
            base[m] = mean if s.squared else np.log(share / (1 - share))
    state = _blocks(df, label, splits, key_cols, names, cuts, base)
    if sizes["rows"] <= ALONE_ROWS:
        live = [m for m in range(len(each)) if sizes[f"n{place[m]}"]]
        got = {}
        if live:
            spark, blocks = df.sparkSession, [_Block.read(r) for r in state.drop("margin").collect()]
            shared = spark.sparkContext.broadcast([(b.bins, b.y, b.roles, b.draw) for b in blocks])
            fit = _whole(each, categorical, place, live, base, cuts, features, shared, rounds, patience, least_improvement)
            for r in spark.range(0, len(live), 1, len(live)).mapInPandas(fit, "model int, fitted binary").collect():
                arrays, kept, losses = pickle.loads(r["fitted"])
                got[r["model"]] = Fitted(Forest(**arrays), kept, losses.tolist())
            shared.unpersist()
        none = {m: Fitted(_forest([], base[m], s, cuts, features), 0) for m, s in enumerate(each) if m not in live}
        return {name: none[m] if m in none else got[m] for m, name in enumerate(specs)}
    state = cut_lineage(state)
    grown: list[list[_Tree]] = [[] for _ in each]
    losses: list[list[float]] = [[] for _ in each]
    live = {m for m in range(len(each)) if sizes[f"n{place[m]}"]}
    held = None

    for r in range(rounds + 1):
        round_trees = {m: _Tree.empty(each[m].depth) for m in live}
        open_ = set(live)
        for level in range(max((each[m].depth for m in live), default=0)):
            todo = {m: round_trees[m] for m in open_ if each[m].depth > level}
            if not todo:
                break
            part = state.mapInPandas(_sums(each, categorical, place, todo, level, r, level == 0), "model int, node int, sums binary")
            found = part.repartition("model", "node").mapInPandas(
                _choose(each, categorical, r), "model int, node int, feature int, bins array<int>, g double, h double, gl double, hl double").collect()
            if level == 0:
                if held is not None:                          # the blocks before this round's
                    held.unpersist()
                    held = None
                for f in found:
                    if f["node"] < 0 and f["g"] is not None:
                        losses[f["model"]].append(f["g"])
                live = {m for m in live if not _done(losses[m], patience, least_improvement)} if r < rounds else set()
                open_ = set(live)
            grew = set()
            for f in found:
                m, node, s = f["model"], f["node"], each[f["model"]]
                if node < 0 or m not in live:
                    continue
                if round_trees[m].grow(s, *f[1:]):
                    grew.add(m)
            open_ &= grew
        if not live:
            break
        step = {m: round_trees[m] for m in live}
        for m, tree in step.items():
            grown[m].append(tree)
        held, last = state, state
        state = last.mapInPandas(_moved(step), last.schema)
        if (r + 1) % KEEP_EVERY == 0:
            state = cut_lineage(state)
            held.unpersist()
            held = None
        else:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
    state.unpersist()
    if held is not None:
        held.unpersist()
    out = {}
    for m, name in enumerate(specs):
        kept = _best(grown[m], losses[m])
        out[name] = Fitted(_forest(grown[m][:kept], base[m], each[m], cuts, features), kept, losses[m])
    return out
