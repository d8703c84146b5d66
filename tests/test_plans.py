"""Plan-shape guards: no nested-loop or cartesian joins in queries whose
helpers once produced them (constant-key joins folded by Catalyst)."""

import pytest

from conftest import SF_SMALL

GUARDED = ["balanced_sample", "cap_negatives", "threshold_table", "neg_ratio_sweep", "prevalence_threshold",
           "zonal_burned_area", "grid_param_sweep", "match_names", "polygon_zone", "pr_curve", "covariate_shift",
           "loyo_summary", "area_match_threshold"]


@pytest.mark.parametrize("name", GUARDED)
def test_no_cross_or_nested_loop_join(spark, name):
    from cinder.plans.catalog import QUERIES
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns_and_pushes_filters(spark):
    from cinder.plans.catalog import QUERIES
    plan = QUERIES["scan_project"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_discount), GreaterThan(l_discount,0.05)]" in plan
    assert "l_extendedprice" not in plan


def _operators(plan):
    """Names of a plan's operators, without those of its scalar subqueries."""
    below = plan.children()
    return [plan.nodeName()] + [n for i in range(below.size()) for n in _operators(below.apply(i))]


@pytest.mark.parametrize("name", ["stratified_split", "loyo_folds"])
def test_splits_do_not_rank_copy_or_join_the_input(spark, name):
    """The rows' own plan has what ``obs`` has; ranks live in the subqueries."""
    from cinder.plans.catalog import QUERIES
    from cinder.plans.common import obs
    plan = lambda df: _operators(df._jdf.queryExecution().optimizedPlan())
    own, rows = plan(QUERIES[name](spark, SF_SMALL)), plan(obs(spark, SF_SMALL))
    assert "Window" not in own
    assert own.count("Join") == rows.count("Join")
    # loyo_folds' summary explodes a few aggregated rows, above its aggregate
    assert "Generate" not in own or own.index("Generate") < own.index("Aggregate", own.index("Generate"))


def test_ranking_helpers_run_no_job_while_a_query_is_built(spark):
    from cinder.operators import metrics, ranking, sampling
    from cinder.plans.common import obs
    o = obs(spark, SF_SMALL).select("grid_row", "grid_col", "year", "month", "label", "score")
    key = ["grid_row", "grid_col", "year", "month"]
    spark.sparkContext.setJobGroup("building", "no job expected")
    try:
        sampling.balanced_sample(o, key)
        sampling.equal_bins(o, "label", key)
        sampling.kfold_assign(o, key)
        sampling.cap_rows(o, key, 100)
        metrics.pr_curve(o, "label", "score", ["year"])
        metrics.curve_summary(o, "label", "score")
        metrics.area_match_threshold(o, "label", "score")
        metrics.area_match_threshold(o, "label", "score", ["year"])
        ranking.exact_quantiles(o, "score", [0.1, 0.9])
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
