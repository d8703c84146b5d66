"""Facts that hold for model queries whatever the fitted trees are."""

import pytest

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def run(spark):
    from cinder.plans.catalog import QUERIES
    return lambda name: QUERIES[name](spark, SF_SMALL).toPandas()


def test_early_stop_ends_the_fit_and_one_round_is_best(run):
    from cinder.operators.models import MAX_ROUNDS
    t = run("best_iteration")
    assert 1 <= len(t) < MAX_ROUNDS and t["is_best"].sum() == 1
    assert t.loc[t["is_best"], "iou"].iloc[0] == t["iou"].max()


def test_permutation_covers_every_feature(run):
    from cinder.operators.models import PERMUTATION_REPEATS
    from cinder.schema import FEATURES
    t = run("permutation_importance")
    assert sorted(t["feature"]) == sorted(FEATURES * PERMUTATION_REPEATS)
    assert t["permuted_auc"].between(0, 1).all() and t["base_auc"].nunique() == 1


def test_stage1_scores_every_cell_by_the_saved_threshold(run, spark):
    from cinder.plans.model_q import _cells, _stage1_model
    t = run("stage1_score")
    assert len(t) == _cells(spark, SF_SMALL).count()
    threshold = _stage1_model(spark, SF_SMALL)[1]
    assert ((t["pred_prob"] >= threshold) == (t["pred_label"] == 1)).all()


def test_importances_are_shares(run):
    t = run("top_features")
    assert len(t) == 6 and (t["importance"] >= 0).all() and t["importance"].sum() <= 1 + 1e-9


def test_split_roles_are_shared_by_repeated_keys_and_keep_null_classes(spark):
    from cinder.operators.sampling import stratified_split
    rows = [(i % 50, None if i % 5 == 0 else i % 2) for i in range(1000)]
    d = spark.createDataFrame(rows, "k int, label int")
    t = stratified_split(d, ["k"], "label", 0.2, 0.2).toPandas()
    assert len(t) == 1000 and t["role"].notna().all()
    assert (t.groupby(["k", t["label"].fillna(-1)])["role"].nunique() == 1).all()
