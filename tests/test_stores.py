"""Completion manifest, bucketed predictor store, densities, shuffle places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_only_whole_committed_units_are_done(spark, tmp_path):
    from cinder.sources.files import done_units, write_partitioned, write_units
    rows = spark.createDataFrame([(i, i % 4, float(i)) for i in range(40)], "k int, unit int, v double")
    data, manifest = f"{tmp_path}/data", f"{tmp_path}/manifest"
    done = lambda: sorted(r.unit for r in done_units(spark, data, manifest, ["unit"], rows.schema).collect())
    assert done() == []
    write_partitioned(rows.where("unit = 3 and k < 20"), data, ["unit"], "append")         # no commit
    write_units(rows.where("unit < 2"), data, manifest, ["unit"])
    assert done() == [0, 1]
    write_partitioned(rows.where("unit = 1 and k < 9"), data, ["unit"], "overwrite")       # lost rows after the commit
    assert done() == [0]
    write_units(rows.where("unit in (1, 3)"), data, manifest, ["unit"])                    # redone as a whole
    assert done() == [0, 1, 3]
    assert spark.read.parquet(data).where("unit = 3").count() == 10


def test_store_merges_without_a_shuffle(spark):
    from cinder.plans.catalog import QUERIES
    plan = QUERIES["predictor_store"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1


def test_densities_are_kernel_densities(spark):
    from cinder.operators.diagnostics import density_by_class
    rng = np.random.default_rng(1)
    rows = [(int(c), float(rng.normal(c * 3, 1 + c)), None if i % 7 == 0 else float(i)) for i in range(3000) for c in (0, 1)] + [(2, 5.0, None), (None, 1.0, 1.0)]
    got = density_by_class(spark.createDataFrame(rows, "label int, a double, b double"), ["a", "b"], "label").toPandas()
    assert set(zip(got["feature"], got["label"])) == {(f, c) for f in "ab" for c in (0, 1)}
    for (f, c), d in got.groupby(["feature", "label"]):
        d = d.sort_values("point")
        v = np.array([r[1 if f == "a" else 2] for r in rows if r[0] == c and r[1 if f == "a" else 2] is not None])
        h = v.std(ddof=1) * len(v) ** -0.2
        exact = np.exp(-0.5 * ((d["x"].to_numpy()[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.trapezoid(d["density"], d["x"]) == pytest.approx(1, abs=0.01)
        assert np.abs(d["density"] - exact).max() < 0.01 * exact.max()


def test_shuffle_places_are_a_permutation(spark):
    from cinder.operators.sampling import shuffle_place
    d = spark.range(5000).withColumnRenamed("id", "k")
    got = shuffle_place(d.repartition(9), ["k"]).toPandas().sort_values("place")
    assert got["place"].tolist() == list(range(1, 5001)) and got["k"].tolist() != sorted(got["k"])
    assert got["k"].tolist() == shuffle_place(d, ["k"]).toPandas().sort_values("place")["k"].tolist()


def test_derived_tables_follow_their_files(spark, tmp_path):
    from cinder.sources.files import input_stamp
    path = f"{tmp_path}/t.parquet"
    spark.range(10).write.parquet(path)
    first = input_stamp(spark, path)
    assert first == input_stamp(spark, path)
    spark.range(10).write.mode("append").parquet(path)
    assert input_stamp(spark, path) != first


def test_writers_leave_the_session_as_it_was(spark, tmp_path):
    from cinder.sources.files import write_partitioned
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    d = spark.createDataFrame([(1, 1), (2, 2)], "k int, year int")
    write_partitioned(d, f"{tmp_path}/w", ["year"], "overwrite")
    write_partitioned(d.where("year = 1").withColumn("k", F.lit(9)), f"{tmp_path}/w", ["year"], "overwrite")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/w").collect())) == [(2, 2), (9, 1)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
