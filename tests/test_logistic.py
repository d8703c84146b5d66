"""The grouped logistic fit against MLlib, one model at a time."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cinder.operators import logistic as lg

SCHEMA = "zone int, k int, y int, a double, b double, c double"
CODES = {"c": [0, 1, 2]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(2400):
        z, a, b, c = int(rng.integers(0, 3)), rng.normal(), rng.normal() * 50 + 10, int(rng.integers(0, 4))
        t = (z - 1) + 1.5 * a - 0.02 * b + (c == 2) - 1
        out.append((z, i, int(rng.random() < 1 / (1 + np.exp(-t))), float(a), float(b), float(c)))
    out += [(None, 9000, 1, 0.0, 0.0, 0.0), (0, 9001, None, 0.0, 0.0, 0.0), (0, 9002, 1, None, 0.0, 0.0), (1, 9003, 0, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(out, SCHEMA).cache()


def mllib(spark, part, l2=1.0):
    """Intercept and coefficients by MLlib on inputs standardised by population deviations."""
    x = np.array([[r.a, r.b, *(float(r.c == k) for k in CODES["c"])] for r in part])
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    d = spark.createDataFrame([(float(r.y), *map(float, v)) for r, v in zip(part, z)], ["y", *[f"x{j}" for j in range(z.shape[1])]])
    d = VectorAssembler(inputCols=[f"x{j}" for j in range(z.shape[1])], outputCol="f").transform(d)
    m = LogisticRegression(featuresCol="f", labelCol="y", regParam=l2 / len(part), standardization=False, tol=1e-14, maxIter=500).fit(d)
    return np.concatenate([[m.intercept], m.coefficients.toArray()])


def test_three_zones_equal_mllib(spark, rows):
    first = F.when(F.col("y") == 1, 0).otherwise(F.col("k") % 3)
    fit = lg.fit_groups(rows, "zone", "y", lg.design(["a", "b", "c"], CODES), first, 3)
    assert len(fit.keys) == 9 and fit.rounds < 15
    held = [r for r in rows.collect() if None not in tuple(r) and r.a == r.a]
    for zone, m in [(0, 0), (1, 2), (2, 1)]:
        part = [r for r in held if r.zone == zone and (r.y == 1 or r.k % 3 <= m)]
        assert np.allclose(fit.beta[fit.place[zone, m]], mllib(spark, part), atol=1e-6)


def test_scores_are_those_of_the_models(spark, rows):
    x = lg.design(["a", "b", "c"], CODES)
    fit = lg.fit_groups(rows, "zone", "y", x, F.lit(0), 1)
    got = lg.score_groups(rows.where("k < 300"), lg.model_table(spark, fit, "zone"), "zone", x).collect()
    intercept, coef = fit.raw()
    for r in got:
        i = fit.place[r.zone, 0]
        t = intercept[i] + coef[i] @ np.array([r.a, r.b, *(float(r.c == k) for k in CODES["c"])])
        assert r.m == 0 and abs(r.p - 1 / (1 + np.exp(-t))) < 1e-12


def test_separable_and_constant_inputs_end(spark):
    d = spark.createDataFrame([(z, i, int(i >= 20), float(i), 3.0) for z in range(2) for i in range(40)],
                              "zone int, k int, y int, a double, b double")
    fit = lg.fit_groups(d, "zone", "y", lg.design(["a", "b"], {}), F.lit(0), 1)
    assert fit.rounds < lg.MAX_ROUNDS and np.isfinite(fit.beta).all() and np.allclose(fit.beta[:, 2], 0)
    assert lg.fit_groups(d.limit(0), "zone", "y", lg.design(["a"], {}), F.lit(0), 1).keys == []


def test_ratio_samples(spark):
    d = spark.createDataFrame([(z, i, int(i < 30 + z)) for z in range(3) for i in range(1000)], "zone int, k int, y int")
    got = lg.ratio_roles(d, "zone", ["zone", "k"], "y", [1, 2, 5, 100]).collect()
    assert len(got) == 3000
    for z in range(3):
        own = [r for r in got if r.zone == z]
        n_pos = 30 + z - -(-(30 + z) // 10)
        assert sum(r.role == "test" for r in own) == -(-(30 + z) // 10) + -(-(970 - z) // 10)
        for at, ratio in enumerate([1, 2, 5, 100]):
            neg = [r for r in own if r.y == 0 and r.role in ("train", "val") and r.from_ratio <= at]
            assert len(neg) == min(ratio * n_pos, r_neg(own)) and abs(sum(r.role == "val" for r in neg) - len(neg) * 2 / 9) <= 1
        assert all(r.from_ratio == 0 for r in own if r.y == 1 and r.role != "test")


def r_neg(own):
    return sum(r.y == 0 and r.role != "test" for r in own)
