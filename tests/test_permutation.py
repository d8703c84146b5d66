"""Permutation importance against pairs and curves made by hand, and the size of its plan."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from cinder.operators import trees
from cinder.plans import model_q
from cinder.schema import FEATURES
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def result(spark):
    from cinder.plans.catalog import QUERIES
    return QUERIES["permutation_importance"](spark, SF_SMALL)


def test_plan_holds_the_counts_a_few_times(result):
    """The driver keeps every copy of a plan and of its quantile cuts: they must not multiply by repeats and joins."""
    plan = result._jdf.queryExecution().analyzed().toString()
    assert plan.count("LogicalRDD") <= 4 and plan.count("percentile_approx(") <= 4


def test_equals_pairs_made_by_hand(spark, result):
    test = model_q._temporal(spark, SF_SMALL)[1].toPandas()
    forest = trees.load(spark, model_q._save_past(spark, SF_SMALL))
    got = result.toPandas().set_index(["feature", "repeat"])
    y = test[model_q.LABEL].to_numpy() == 1

    def auc(frame):
        r = pd.Series(forest.scores(trees.matrix({n: frame[n] for n in forest.names}, forest.names))).rank()
        return (r[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())

    def order(salt):
        keys = list(zip(*[test[k] for k in model_q.KEY]))
        h = lambda k: int(hashlib.md5("_".join(map(str, (salt, *k))).encode()).hexdigest()[:8], 16)
        return np.array(sorted(range(len(keys)), key=lambda i: (h(keys[i]), keys[i])))

    for rep in (0, 3):
        a, b = order(f"pa{rep}"), order(f"pb{rep}")
        for f in FEATURES:
            v = test[f].to_numpy().copy()
            v[a] = test[f].to_numpy()[b]
            assert got.loc[(f, rep), "permuted_auc"] == pytest.approx(auc(test.assign(**{f: v})), abs=1e-9)
            assert got.loc[(f, rep), "base_auc"] == pytest.approx(auc(test), abs=1e-9)
