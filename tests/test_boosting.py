"""Grouped boosting against a slow one-model fit, and the facts that hold for any fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinder.operators import boosting, trees
from cinder.operators.boosting import Spec, fit_groups
from cinder.operators.models import with_validation
from cinder.schema import FEATURES

SHORT = ["DEM", "slope", "b1"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(900):
        f = [float(rng.integers(0, 12)), float(rng.integers(0, 20)), float(rng.integers(0, 6))]
        t = f[0] / 4 - f[1] / 9 + 2 * (f[2] in (1.0, 4.0)) - 1
        out.append((i, i % 3, int(rng.random() < 1 / (1 + np.exp(-t))), t, *f))
    d = spark.createDataFrame(out, ["k", "fold", "y", "t", *SHORT])
    d = d.withColumn("DEM", F.when(F.col("k") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("DEM")))
    d = with_validation(d, ["k"], "y")
    role = lambda out_: F.when(F.col("fold") == out_, 0).when(F.col("is_val"), 2).otherwise(1)
    return d.withColumns({"all": role(-1), "no0": role(0), "no1": role(1)}).cache()


def slow_tree(x, g, h, s, depth):
    """A tree by trying every cut of every column on the rows themselves: a function of a row."""
    value = -s.step * g.sum() / (h.sum() + s.l2)
    if depth == 0:
        return lambda r: value
    worth = lambda on: g[on].sum() ** 2 / (h[on].sum() + s.l2)
    best, test = 1e-9, None
    for f in range(x.shape[1]):
        v = x[:, f]
        if SHORT[f] == "b1":
            codes = sorted(set(v), key=lambda c: (g[v == c].sum() / (h[v == c].sum() + s.l2), c))
            tests = [(lambda a, left=frozenset(codes[:i]): np.isin(a, list(left))) for i in range(1, len(codes))]
        else:
            tests = [(lambda a, c=c: a <= c) for c in sorted(set(v[~np.isnan(v)]))]
        for go in tests:
            on = go(v)
            if h[on].sum() < s.least_weight or h[~on].sum() < s.least_weight:
                continue
            gain = (worth(on) + worth(~on) - worth(np.ones(len(v), bool))) / 2
            if gain > best + 1e-7:
                best, test = gain, (f, go, on)
    if test is None:
        return lambda r: value
    f, go, on = test
    left, right = (slow_tree(x[m], g[m], h[m], s, depth - 1) for m in (on, ~on))
    return lambda r: left(r) if go(np.array([r[f]]))[0] else right(r)


@pytest.mark.parametrize("squared", [False, True])
def test_equals_a_slow_fit_on_the_rows(rows, squared):
    label, s = ("t" if squared else "y"), Spec("no0", depth=2, step=0.3, least_weight=2.0, squared=squared)
    got = fit_groups(rows, label, {"m": s}, ["k"], SHORT, rounds=3, patience=9)["m"]
    d = rows.toPandas()
    fit, x = d[d["no0"] == 1], d[["DEM", "slope", "b1"]].to_numpy(float)
    xf, y = fit[["DEM", "slope", "b1"]].to_numpy(float), fit[label].to_numpy(float)
    m0 = y.mean() if squared else np.log(y.mean() / (1 - y.mean()))
    margin, every = np.full(len(fit), m0), np.full(len(d), m0)
    for _ in range(got.rounds):
        p = margin if squared else 1 / (1 + np.exp(-margin))
        t = slow_tree(xf, p - y, np.ones(len(y)) if squared else p * (1 - p), s, 2)
        margin = margin + [t(r) for r in xf]
        every = every + [t(r) for r in x]
    assert got.rounds == 3
    want = every if squared else 1 / (1 + np.exp(-every))
    assert np.abs(got.forest.scores(trees.matrix({n: d[n] for n in SHORT}, got.forest.names)) - want).max() < 1e-4


def test_a_model_does_not_depend_on_the_others_nor_on_the_deal(rows):
    specs = {n: Spec(n, depth=3, step=0.3, least_weight=5.0) for n in ("no0", "no1", "all")}
    both = fit_groups(rows.repartition(5, "t"), "y", specs, ["k"], SHORT, rounds=5, patience=9)
    alone = fit_groups(rows.coalesce(1), "y", {"no1": specs["no1"]}, ["k"], SHORT, rounds=5, patience=9)["no1"]
    assert alone.rounds == both["no1"].rounds and np.array_equal(alone.forest.value, both["no1"].forest.value)
    assert not np.array_equal(both["no0"].forest.value[:20], both["no1"].forest.value[:20])


def test_patience_keeps_the_best_round(rows):
    s = Spec("all", depth=3, step=0.8, least_weight=1.0, rows=0.7, columns=0.7)
    got = fit_groups(rows, "y", {"m": s}, ["k"], SHORT, rounds=60, patience=4)["m"]
    assert len(got.losses) < 61 and got.rounds == int(np.argmin(got.losses)) >= len(got.losses) - 5
    d = rows.where("is_val").toPandas()
    p = got.forest.scores(trees.matrix({n: d[n] for n in SHORT}, got.forest.names))
    loss = -(d["y"] * np.log(p) + (1 - d["y"]) * np.log(1 - p)).mean()
    assert abs(loss - got.losses[got.rounds]) < 1e-4 and len(got.forest.root) == got.rounds + 1


def test_state_written_every_few_rounds_changes_nothing(rows, monkeypatch):
    s = {"m": Spec("all", depth=2, rows=0.5)}
    long = fit_groups(rows, "y", s, ["k"], SHORT, rounds=5, patience=9)["m"]
    monkeypatch.setattr(boosting, "KEEP_EVERY", 2)
    kept = fit_groups(rows, "y", s, ["k"], SHORT, rounds=5, patience=9)["m"]
    assert np.array_equal(long.forest.value, kept.forest.value) and long.losses == kept.losses


def test_odd_tables(spark, rows):
    s = {"m": Spec("all", depth=2)}
    none = fit_groups(rows.where("false"), "y", s, ["k"], SHORT, rounds=3)["m"]
    assert none.rounds == 0 and none.forest.scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = fit_groups(rows.where("y = 1"), "y", s, ["k"], SHORT, rounds=3, patience=2)["m"]
    assert (one.forest.scores(np.zeros((2, 3))) > 0.99).all()
    null = rows.withColumns({"slope": F.lit(None).cast("double"), "y": F.when(F.col("k") % 5 > 0, F.col("y")),
                             "b1": F.when(F.col("k") % 2 == 0, F.lit(500.0))})
    got = fit_groups(null, "y", s, ["k"], SHORT, rounds=3, patience=2)["m"]
    assert got.losses[-1] <= got.losses[0] and not (got.forest.feature == got.forest.names.index("slope")).any()


def test_weights_move_the_base_rate(rows):
    s = {f"w{w}": Spec("all", depth=1, positive_weight=float(w)) for w in (1, 9)}
    got = fit_groups(rows, "y", s, ["k"], SHORT, rounds=1, patience=9)
    d = rows.where("all = 1").toPandas()["y"]
    for w in (1, 9):
        p = w * d.sum() / (w * d.sum() + (1 - d).sum())
        assert abs(got[f"w{w}"].forest.value[0] - np.log(p / (1 - p))) < 1e-9


def test_default_features_score_in_one_scan(spark, rows):
    d = rows.select("*", *[F.lit(0.0).alias(f) for f in FEATURES if f not in SHORT])
    got = fit_groups(d, "y", {"m": Spec("all", depth=2)}, ["k"], rounds=2, patience=9)["m"]
    s = trees.score_models(d, {"m": got.forest}).select("scores").toPandas()["scores"]
    assert all(0 < v[0]["p"] < 1 for v in s)
