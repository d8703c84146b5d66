"""Node-table evaluation against MLlib's own transform and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinder.operators import trees
from cinder.operators.models import fit_pipeline, gbt_classifier, gbt_regressor, score, with_validation
from cinder.schema import FEATURES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(1200):
        f = [float(v) for v in rng.normal(size=len(FEATURES))]
        f[FEATURES.index("b1")] = float(rng.integers(0, 7))
        t = f[0] + f[5] * f[6] + (f[FEATURES.index("b1")] in (2.0, 5.0)) - 0.5
        out.append((i, i % 3, int(rng.random() < 1 / (1 + np.exp(-2 * t))), abs(t), *f))
    d = spark.createDataFrame(out, ["k", "year", "y", "fraction", *FEATURES])
    return with_validation(d, ["k"], "y").cache()


@pytest.fixture(scope="module")
def saved(spark, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    fits = {"deep": gbt_classifier("y", min_instances=5, max_iter=12), "flat": gbt_classifier("y", max_depth=1, min_instances=5, max_iter=9),
            "area": gbt_regressor("fraction", max_iter=6)}
    out = {}
    for name, g in fits.items():
        model = fit_pipeline(rows, g)
        model.write().save(f"{root}/{name}")
        out[name] = model, trees.load(spark, f"{root}/{name}")
    return out


ODD = [None, float("nan"), -3.0, 99.0, 150.0, 2.4]


def odd(rows):
    """Codes outside the dictionary and values that are missing."""
    return rows.withColumns({"b1": F.get(F.array(*[F.lit(v).cast("double") for v in [*ODD, 1.0, 2.0, 5.0]]), F.col("k") % 9),
                             "DEM": F.when(F.col("k") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("DEM"))})


def test_scores_equal_transform(rows, saved):
    d = odd(rows)
    got = {r.k: r.scores for r in trees.score_models(d, {n: f for n, (_, f) in saved.items()}).collect()}
    for i, (name, (model, _)) in enumerate(saved.items()):
        s = score(model, d)
        want = {r.k: r.v for r in s.select("k", F.col("p" if name != "area" else "prediction").alias("v")).collect()}
        assert all(got[k][i].model == name and abs(got[k][i].p - v) < 1e-9 for k, v in want.items())


def test_one_scan_scores_all_models(rows, saved, spark, tmp_path):
    rows.write.parquet(f"{tmp_path}/rows")
    d = trees.score_models(spark.read.parquet(f"{tmp_path}/rows"), {n: f for n, (_, f) in saved.items()})
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and "Exchange" not in plan


def test_each_row_by_its_own_model(rows, saved):
    forests = {0: saved["deep"][1], 1: saved["flat"][1]}
    got = trees.score_by_key(rows, forests, "year").select("k", "year", "p").collect()
    want = {r.k: r.scores for r in trees.score_models(rows, {"0": forests[0], "1": forests[1]}).collect()}
    assert all((r.p is None) if r.year == 2 else r.p == want[r.k][r.year].p for r in got) and len(got) == 1200


def test_prefixes_equal_each_prefix(rows, saved):
    forest = saved["deep"][1]
    got = {r.iteration: r.iou for r in trees.prefix_metrics(rows, forest, "y").collect()}
    data = rows.toPandas()
    x = trees.matrix({n: data[n] for n in forest.names}, forest.names)
    out = np.concatenate([t for _, t in forest.outputs(x)])
    for k in range(1, len(forest.root) + 1):
        hit, y = out[:, :k].sum(axis=1) >= 0, data["y"].to_numpy() == 1
        union = (hit | y).sum()
        assert got[k] == (None if not union else pytest.approx((hit & y).sum() / union))
    assert len(got) == len(forest.root)


@pytest.mark.parametrize("name", ["deep", "flat", "area"])
def test_dependence_equals_replacing_the_feature_in_every_row(rows, saved, name):
    model, forest = saved[name]
    grids = {"DEM": [-1.0, 0.0, 0.3, 2.0], "temperature_2m": [-0.5, 0.5], "b1": [0.0, 2.0, 5.0, 77.0]}
    got = trees.partial_dependence(rows, forest, grids)
    data = rows.toPandas()
    for f, grid in grids.items():
        for i, v in enumerate(grid):
            x = trees.matrix({n: data[n] if n != f else np.full(len(data), v) for n in forest.names}, forest.names)
            assert got[f][i] == pytest.approx(forest.margins(x).mean(), abs=1e-9)


def test_no_rows(rows, saved, spark):
    none = rows.limit(0)
    forest = saved["deep"][1]
    assert trees.score_models(none, {"a": forest}).count() == 0 and trees.prefix_metrics(none, forest, "y").count() == 0
    assert np.isnan(trees.partial_dependence(none, forest, {"DEM": [0.0]})["DEM"]).all()


def test_a_thousand_trees_take_seconds(rows, saved):
    import dataclasses
    import time
    f = saved["deep"][1]
    many = dataclasses.replace(f, root=np.tile(f.root, 400), weight=np.tile(f.weight, 400))
    began = time.time()
    assert trees.prefix_metrics(rows, many, "y").count() == len(many.root) >= 1000
    assert time.time() - began < 20
