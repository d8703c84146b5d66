"""Spark query vs DuckDB oracle on the smallest scale factor (one query per
operator family; tools/oracle_check.py runs all of them at sf0.01)."""

import pytest

from oracle_check import compare, duck

from conftest import SF_SMALL

SAMPLE = [
    "zonal_burned_area", "annual_composite", "coarse_grid", "grid_param_sweep", "smart_grid_choice",
    "sanitize_names", "match_names", "clean_training", "phys_filter", "fraction_bins", "balanced_sample",
    "equal_bins", "neg_pos_ratio_sweep", "stratified_split", "kfold_assign", "loyo_folds", "pr_curve",
    "roc_auc", "thr_max_f1", "area_match_threshold", "loyo_summary", "focal_terms", "area_multi_threshold",
    "robust_scale", "covariate_shift", "compare_products", "area_error_report", "join_predictions",
    "join_predictors", "polygon_zone", "project_lonlat", "burn_fraction_nodata", "bilinear_resample",
    "scan_partition_filter", "incremental_todo", "json_meta_extract", "grid_fill", "incremental_annual_mask",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    from cinder.plans.catalog import ORACLE, QUERIES
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    exp = duck(ORACLE[name], SF_SMALL)
    ok, msg = compare(got, exp)
    assert ok, msg


def test_every_oracle_has_a_query():
    from cinder.plans.catalog import ORACLE, QUERIES
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 130


def test_entry_returns_rows(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["zone_id", "ecoregion", "year", "burned_mha"]
