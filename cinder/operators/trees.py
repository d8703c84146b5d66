"""Boosted trees as node tables: one pass over the rows for any number of models.

A saved tree ensemble is a table of nodes already (tree, node, feature, threshold or
left categories, children, output).  ``load`` reads it into flat arrays; rows are then
evaluated in Arrow batches by walking all trees of a model level by level, so that

* many models score a row in one scan (L16), or each row its own year's model (E9);
* every prefix of an ensemble is judged by a running sum over its trees (K9);
* partial dependence needs no copies of the rows (L14): one pass counts, for each leaf
  and each feature on its path, the rows that pass all other tests of the path.  The
  mean margin at any value of that feature is a sum over leaves of output times such a
  share, which equals averaging the model over all rows with the feature replaced.

The arrays of a model hold its nodes (3,000 trees of depth 4: 93,000 nodes, 3 MB); they
travel in a broadcast.  Rows stay distributed; counts leave a task already added up.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinder.operators.models import B1_CATEGORIES
from cinder.schema import CATEGORICAL, FEATURES

_CELLS = 1 << 20       # rows times trees walked at a time
# Functions that run in tasks travel with the job: executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Forest:
    """A boosted ensemble in flat arrays; a leaf's children are itself."""
    root: np.ndarray           # by tree: its first node
    weight: np.ndarray         # by tree
    feature: np.ndarray        # by node, -1 in leaves
    threshold: np.ndarray      # by node
    category: np.ndarray       # by node: row of ``left_of`` for a test of categories, else -1
    left_of: np.ndarray        # which categories go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray          # by node
    classifier: bool = True    # the score is 1 / (1 + exp(-2 margin)), else the margin itself
    features: tuple[str, ...] = tuple(FEATURES)

    @property
    def names(self) -> list[str]:
        """Inputs in the order of the tests: numeric ones, then categories."""
        return [f for f in self.features if f not in CATEGORICAL] + [f for f in self.features if f in CATEGORICAL]

    def outputs(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(rows, weighted output of each tree) in blocks of rows."""
        rows = max(1, _CELLS // max(1, len(self.root)))
        for at in range(0, len(x), rows):
            part = x[at:at + rows]
            node = np.broadcast_to(self.root, (len(part), len(self.root))).copy()
            while True:
                test = self.feature[node]
                inner = test >= 0
                if not inner.any():
                    break
                v = np.take_along_axis(part, np.maximum(test, 0), axis=1)
                go = v <= self.threshold[node]
                kind = self.category[node]
                if (kind >= 0).any():
                    code = np.clip(np.nan_to_num(v), 0, self.left_of.shape[1] - 1).astype(int)
                    go = np.where(kind >= 0, self.left_of[np.maximum(kind, 0), code], go)
                node = np.where(inner, np.where(go, self.left[node], self.right[node]), node)
            yield slice(at, at + len(part)), self.value[node] * self.weight

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for rows, trees in self.outputs(x):
            out[rows] = trees.sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        m = self.margins(x)
        return 1 / (1 + np.exp(-2 * m)) if self.classifier else m


def constant(p: float, features: Sequence[str] = tuple(FEATURES)) -> Forest:
    """A classifier of one leaf that scores every row with ``p``, kept off 0 and 1."""
    share, own = min(max(p, 1e-6), 1 - 1e-6), np.zeros(1, int)
    return Forest(own, np.ones(1), own - 1, np.full(1, np.inf), own - 1, np.zeros((1, 1), bool), own, own,
                  np.array([np.log(share / (1 - share)) / 2]), True, tuple(features))


def load(spark: SparkSession, path: str, features: Sequence[str] = tuple(FEATURES)) -> Forest:
    """The ensemble at the end of a saved pipeline."""
    nodes = spark.read.parquet(f"{path}/stages/*_GBT*/data").select("treeID", "nodeData.*").select(
        F.col("treeID").alias("tree"), "id", F.col("prediction").alias("value"), F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("split.numCategories").alias("kinds")).toPandas()
    weights = spark.read.parquet(f"{path}/stages/*_GBT*/treesMetadata").select("_1", "_3").toPandas().sort_values("_1")
    name = spark.read.text(f"{path}/stages/*_GBT*/metadata").first()[0]
    nodes = nodes.sort_values(["tree", "id"]).reset_index(drop=True)
    root = nodes.groupby("tree").head(1).index.to_numpy()
    base = root[nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1]
    leaf = nodes["left"].to_numpy() < 0
    own = np.arange(len(nodes))
    kinds = nodes["kinds"].to_numpy()
    category = np.full(len(nodes), -1)
    tests = np.flatnonzero(~leaf & (kinds >= 0))
    left_of = np.zeros((len(tests), int(kinds.max(initial=0)) + 1 if len(tests) else 1), bool)
    for i, n in enumerate(tests):
        category[n] = i
        left_of[i, np.asarray(nodes["cut"][n], int)] = True
    threshold = np.array([c[0] if k < 0 and len(c) else np.inf for c, k in zip(nodes["cut"], kinds)], float)
    return Forest(root, weights["_3"].to_numpy(float), np.where(leaf, -1, nodes["feature"].to_numpy()), threshold, category, left_of,
                  np.where(leaf, own, base + nodes["left"].to_numpy()), np.where(leaf, own, base + nodes["right"].to_numpy()),
                  nodes["value"].to_numpy(float), "GBTClassificationModel" in name, tuple(features))


def matrix(columns: dict[str, np.ndarray], names: Sequence[str]) -> np.ndarray:
    """Inputs side by side; a category's place in the fixed dictionary, unseen and null codes after the last."""
    out = []
    for n in names:
        v = np.asarray(columns[n], float)
        if n in CATEGORICAL:
            code = np.rint(v)
            v = np.where(np.isfinite(code) & (code >= 0) & (code < len(B1_CATEGORIES)), code, len(B1_CATEGORIES))
        out.append(v)
    return np.stack(out, axis=1) if out else np.zeros((0, 0))


def score_models(df: DataFrame, forests: dict[str, Forest], to: str = "scores") -> DataFrame:
    """``df`` with ``to``: (model, p) for every model, from one scan."""
    shared = df.sparkSession.sparkContext.broadcast({k: vars(f) for k, f in forests.items()})
    names = next(iter(forests.values())).names

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        x = matrix(dict(zip(names, columns)), names)
        return pd.Series(list(np.stack([f.scores(x) for f in (Forest(**v) for v in shared.value.values())], axis=1)))

    models = F.array(*[F.lit(m) for m in forests])
    return df.withColumn(to, F.arrays_zip(models.alias("model"), score(*[F.col(n).cast("double") for n in names]).alias("p")))


def score_by_key(df: DataFrame, forests: dict[int, Forest], key: str, to: str = "p") -> DataFrame:
    """``df`` with the score of the model that its ``key`` names (null for none), from one scan."""
    shared = df.sparkSession.sparkContext.broadcast({k: vars(f) for k, f in forests.items()})
    names = next(iter(forests.values())).names

    @F.pandas_udf("double")
    def score(which: pd.Series, *columns: pd.Series) -> pd.Series:
        x = matrix(dict(zip(names, columns)), names)
        out = np.full(len(x), np.nan)
        for k, arrays in shared.value.items():
            forest = Forest(**arrays)
            own = (which == k).to_numpy()
            if own.any():
                out[own] = forest.scores(x[own])
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return df.withColumn(to, score(F.col(key), *[F.col(n).cast("double") for n in names]))


def score_replaced(df: DataFrame, forest: Forest, other: str, to: str = "scores") -> DataFrame:
    """``df`` with ``to``: (feature, p) of the row as it is (feature '') and with each feature in
    turn taken from its column named ``other`` + feature, from one scan and without copies of the row."""
    shared = df.sparkSession.sparkContext.broadcast(vars(forest))
    names = forest.names

    @F.pandas_udf("array<double>")
    def score(*columns: pd.Series) -> pd.Series:
        own = Forest(**shared.value)
        x, y = (matrix(dict(zip(names, part)), names) for part in (columns[:len(names)], columns[len(names):]))
        out = [own.scores(x)]
        for j in range(len(names)):
            x[:, j], kept = y[:, j], x[:, j].copy()
            out.append(own.scores(x))
            x[:, j] = kept
        return pd.Series(list(np.stack(out, axis=1)))

    p = score(*[F.col(n).cast("double") for n in [*names, *[other + n for n in names]]])
    return df.withColumn(to, F.arrays_zip(F.array(*map(F.lit, ["", *names])).alias("feature"), p.alias("p")))


def score_models_by_key(df: DataFrame, forests: dict[int, dict[str, Forest]], key: str, to: str = "scores") -> DataFrame:
    """``df`` with ``to``: (model, p) for the models that the row's ``key`` names, an empty
    array for none, from one scan: out-of-fold scores of a whole search."""
    shared = df.sparkSession.sparkContext.broadcast({k: {n: vars(f) for n, f in named.items()} for k, named in forests.items()})
    names = next(iter(next(iter(forests.values())).values())).names

    @F.pandas_udf("array<double>")
    def score(which: pd.Series, *columns: pd.Series) -> pd.Series:
        x, out = matrix(dict(zip(names, columns)), names), np.empty(len(which), object)
        for k, named in shared.value.items():
            own = np.flatnonzero((which == k).to_numpy())
            if len(own):
                p = np.stack([Forest(**v).scores(x[own]) for v in named.values()], axis=1)
                for i, row in zip(own, p):
                    out[i] = row
        return pd.Series(out)

    models = F.coalesce(*[F.when(F.col(key) == k, F.array(*map(F.lit, named))) for k, named in forests.items()])
    p = score(F.col(key), *[F.col(n).cast("double") for n in names])
    return df.withColumn(to, F.coalesce(F.arrays_zip(models.alias("model"), p.alias("p")),
                                        F.array().cast("array<struct<model:string,p:double>>")))


def _added_up(df: DataFrame, names: Sequence[str], count: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum of ``count(batch)`` over all rows: a task gives its total once."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                c = count(batch)
                total = c if total is None else total + c
        if total is not None:
            yield pd.DataFrame({"j": np.arange(len(total)), "v": total})

    cols = [F.col(n).cast("double").alias(n) for n in names]
    got = df.select(*cols).mapInPandas(add, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(got["j"].max()) + 1 if len(got) else 0)
    out[got["j"]] = got["v"]
    return out


def prefix_metrics(df: DataFrame, forest: Forest, label: str) -> DataFrame:
    """(iteration, iou) of every prefix of the ensemble at p >= 0.5: a running sum over each
    row's trees, confusion counts added up by place.  Rows without a label are left out."""
    trees = len(forest.root)

    def count(batch: pd.DataFrame) -> np.ndarray:
        x, y = matrix({n: batch[n] for n in forest.names}, forest.names), batch[label].to_numpy(float) == 1
        tp, said = np.zeros(trees), np.zeros(trees)
        for rows, out in forest.outputs(x):
            hit = np.cumsum(out, axis=1) >= 0                # p >= 0.5
            tp += hit[y[rows]].sum(axis=0)
            said += hit.sum(axis=0)
        return np.concatenate([tp, said, [y.sum()]])

    s = _added_up(df.where(F.col(label).isNotNull()), [*forest.names, label], count)
    spark = df.sparkSession
    if not len(s):
        return spark.createDataFrame([], "iteration int, iou double")
    tp, said, pos = s[:trees], s[trees:2 * trees], s[-1]
    union = said + pos - tp
    return spark.createDataFrame([(i + 1, float(tp[i] / union[i]) if union[i] else None) for i in range(trees)], "iteration int, iou double")


def _freed(forest: Forest) -> list[tuple[int, int, int, list[tuple[int, bool]]]]:
    """(tree, leaf, feature, tests on that feature as (node, goes left)) for every leaf and every
    feature on its path, and once with feature -1: the slots that ``partial_dependence`` counts."""
    out = []
    for t, root in enumerate(forest.root):
        todo: list[tuple[int, list[tuple[int, bool]]]] = [(int(root), [])]
        while todo:
            node, path = todo.pop()
            f = int(forest.feature[node])
            if f >= 0:
                todo += [(int(forest.right[node]), [*path, (node, False)]), (int(forest.left[node]), [*path, (node, True)])]
                continue
            out.append((t, node, -1, []))
            for g in sorted({int(forest.feature[n]) for n, _ in path}):
                out.append((t, node, g, [(n, left) for n, left in path if forest.feature[n] == g]))
    return out


def _passes(forest: Forest, node: int, v: np.ndarray) -> np.ndarray:
    """Which values go left at a node."""
    if forest.category[node] >= 0:
        row = forest.left_of[forest.category[node]]
        return row[np.clip(np.nan_to_num(v), 0, len(row) - 1).astype(int)]
    return v <= forest.threshold[node]


def leaf_counts(df: DataFrame, forest: Forest) -> tuple[np.ndarray, float]:
    """(rows of each slot of ``_freed``, all rows): rows that pass every test on the way to the
    slot's leaf but those on the slot's feature."""
    def count(batch: pd.DataFrame) -> np.ndarray:
        x = matrix({n: batch[n] for n in forest.names}, forest.names)
        sums: list[int] = []
        for root in forest.root:
            todo = [(int(root), {-1: np.ones(len(x), bool)})]
            while todo:
                node, held = todo.pop()
                f = int(forest.feature[node])
                if f < 0:
                    sums += [int(held[g].sum()) for g in sorted(held)]
                    continue
                go = _passes(forest, node, x[:, f])
                held = held if f in held else {**held, f: held[-1]}
                todo += [(int(forest.right[node]), {g: m if g == f else m & ~go for g, m in held.items()}),
                         (int(forest.left[node]), {g: m if g == f else m & go for g, m in held.items()})]
        return np.array([*sums, len(x)], float)

    s = _added_up(df, forest.names, count)
    return (s[:-1], float(s[-1])) if len(s) else (np.zeros(len(_freed(forest))), 0.0)


def partial_dependence(df: DataFrame, forest: Forest, grids: dict[str, Sequence[float]]) -> dict[str, np.ndarray]:
    """The mean margin over all rows with one feature set to each value of its grid."""
    counts, rows = leaf_counts(df, forest)
    slots = _freed(forest)
    names = forest.names
    whole = {(t, leaf): c for (t, leaf, g, _), c in zip(slots, counts) if g < 0}
    out = {}
    for name, grid in grids.items():
        f = names.index(name)
        v = matrix({name: np.asarray(grid, float)}, [name])[:, 0]
        total = np.zeros(len(v))
        tested = {(t, leaf): (c, path) for (t, leaf, g, path), c in zip(slots, counts) if g == f}
        for (t, leaf), c in whole.items():
            share = np.full(len(v), c)
            if (t, leaf) in tested:
                free, path = tested[t, leaf]
                on = np.ones(len(v), bool)
                for node, left in path:
                    on &= _passes(forest, node, v) == left
                share = np.where(on, free, 0.0)
            total += forest.weight[t] * forest.value[leaf] * share
        out[name] = total / rows if rows else np.full(len(v), np.nan)
    return out
