"""Whole models grown in a task each: equal to the passes, and as patient as the reference."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinder.operators import boosting
from cinder.operators.boosting import Spec, fit_groups
from cinder.operators.models import with_validation
from cinder.plans import model_q
from cinder.schema import FEATURES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = []
    for i in range(400):
        f = [float(v) for v in rng.normal(size=len(FEATURES))]
        f[FEATURES.index("b1")] = float(rng.integers(0, 7))
        t = f[0] + f[5] * f[6] + (f[FEATURES.index("b1")] in (2.0, 5.0)) - 0.5
        out.append((i, float(rng.random() < 1 / (1 + np.exp(-2 * t))), t, *f))
    d = spark.createDataFrame(out, ["k", "y", "t", *FEATURES])
    d = with_validation(d, ["k"], "y")
    return d.withColumns({"watched": F.when(F.col("is_val"), 2).otherwise(1), "half": (F.col("k") % 2).cast("int"), "none": F.lit(0)}).cache()


@pytest.mark.parametrize("label, more", [("y", {}), ("t", {"squared": True})])
def test_equals_the_passes(rows, monkeypatch, label, more):
    specs = {"a": Spec("watched", depth=3, step=0.5, rows=0.7, columns=0.5, positive_weight=2.0, **more),
             "b": Spec("half", depth=2, l1=0.1, least_weight=3.0, **more), "c": Spec("none", **more),
             "d": Spec("watched", depth=4, step=0.9, least_gain=0.3, **more)}
    alone = fit_groups(rows, label, specs, ["k"], rounds=12, patience=4, least_improvement=0.0)
    monkeypatch.setattr(boosting, "ALONE_ROWS", 0)
    passes = fit_groups(rows, label, specs, ["k"], rounds=12, patience=4, least_improvement=0.0)
    for m in specs:
        x, y = alone[m], passes[m]
        assert x.rounds == y.rounds and x.losses == y.losses
        assert all(np.array_equal(getattr(x.forest, v), getattr(y.forest, v)) for v in vars(x.forest) if v not in ("classifier", "features"))
    assert alone["b"].rounds == 12 and alone["c"].rounds == 0 and 0 < alone["a"].rounds


def test_a_search_waits_200_rounds_without_any_gain(rows):
    draws = [dict(depth=2, step=0.1), dict(depth=3, step=0.05, rows=0.8)]
    s, fits = model_q._out_of_fold(rows, "y", draws, 2, ["k"])
    assert s.count() == 2 * rows.count() and len(fits) == 4
    for f in fits.values():
        assert f.rounds > 0 and (len(f.losses) == 10_001 or len(f.losses) >= f.rounds + 201)
        assert f.losses[f.rounds] == min(f.losses)


def test_rows_of_one_class_end_after_the_patience(rows):
    _, fits = model_q._out_of_fold(rows.where("y = 1"), "y", [dict(depth=2)], 2, ["k"])
    assert all(len(f.losses) < 10_001 and f.forest.scores(np.zeros((1, len(FEATURES))))[0] > 0.99 for f in fits.values())
