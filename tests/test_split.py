"""The best split of a node against every split tried one by one."""

import numpy as np

from cinder.operators import boosting


def test_best_split_is_the_first_of_the_greatest_gain():
    rng, categorical = np.random.default_rng(5), [False, False, False, True]
    spec = boosting.Spec("x", least_weight=0.1)
    for _ in range(60):
        g, h = np.zeros((2, 4, boosting._WIDTH))
        gr, hr = np.rint(rng.normal(size=40) * 1024) / 1024, np.rint(rng.random(40) * 1024) / 1024
        for f in range(4):
            at = rng.integers(0, 4 if f == 1 else boosting.BINS + 1, 40)
            np.add.at(g[f], at, gr)
            np.add.at(h[f], at, hr)
        tried = []
        for f in range(4):
            order = np.flatnonzero(h[f] > 0) if categorical[f] else np.arange(boosting._WIDTH)
            if categorical[f]:
                order = order[np.argsort(g[f][order] / (h[f][order] + spec.l2), kind="stable")]
            for i in range(1, len(order)):
                gl, hl = g[f][order[:i]].sum(), h[f][order[:i]].sum()
                if min(hl, h[f].sum() - hl) >= spec.least_weight:
                    worth = lambda a, b: a * a / (b + spec.l2)
                    tried.append(((worth(gl, hl) + worth(g[f].sum() - gl, h[f].sum() - hl) - worth(g[f].sum(), h[f].sum())) / 2, f, order[:i]))
        gain, f, left = max(tried, key=lambda t: t[0])
        got = boosting.best_split(g, h, spec, categorical, range(4))
        assert (got is not None) == (gain > 1e-9)
        if got:
            assert got[0] == f and list(got[1]) == list(left)


def test_sums_hold_no_places_that_a_numeric_feature_lacks():
    feature, bins = boosting._places([False, True, False])
    assert np.bincount(feature).tolist() == [boosting.BINS + 1, boosting._WIDTH, boosting.BINS + 1]
    assert bins[feature == 2].tolist() == list(range(boosting.BINS + 1))
