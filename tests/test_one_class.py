"""Model queries on tables where a class is missing or rare."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinder.operators import models, trees
from cinder.plans import model_q
from cinder.schema import FEATURES
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def one_class(spark, tmp_path_factory):
    """The small tables with no discount: no pixel-month burned."""
    d = str(tmp_path_factory.mktemp("one_class"))
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    li.withColumn("l_discount", F.lit(0).cast(li.schema["l_discount"].dataType)).write.parquet(f"{d}/lineitem.parquet")
    spark.read.parquet(f"{SF_SMALL}/part.parquet").write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("labels, weight", [([0, 0, 0], 3.0), ([1, 1], 1.0), ([0, 0, 0, 1, 1], 1.5)])
def test_class_weight_without_a_class(spark, labels, weight):
    df = spark.createDataFrame([(y,) for y in labels], "y int")
    assert df.select(models.class_ratio("y")).first()[0] == weight
    got = models.class_weight_col(df, "y").collect()
    assert {r.w for r in got if r.y == 0} <= {1.0} and {r.w for r in got if r.y == 1} <= {weight}


def test_class_weight_sweep_without_positives(spark, one_class):
    got = model_q.q_class_weight_sweep(spark, one_class).collect()
    assert len(got) == 3 and all((r.TP, r.FP, r.FN) == (0, 0, 0) and r.TN > 0 for r in got)


@pytest.mark.parametrize("burned", [0, 3])
def test_bags_too_small_to_split(spark, one_class, tmp_path, burned):
    li = spark.read.parquet(f"{one_class}/lineitem.parquet")
    early = li.groupBy("l_partkey").agg(F.min(F.year("l_shipdate")).alias("y")).where("y < 1999").orderBy("l_partkey").limit(burned)
    hit = early.withColumn("hit", F.lit(True)).drop("y")
    d = F.when(F.col("hit"), F.lit(0.1)).otherwise(F.lit(0.0)).cast(li.schema["l_discount"].dataType)
    li.join(hit, "l_partkey", "left").withColumn("l_discount", d).drop("hit").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{one_class}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    got = model_q.q_balanced_bagging(spark, str(tmp_path)).collect()
    assert {r.year for r in got} == set(model_q.TEST_YEARS) and all(r.n_neg > 0 for r in got)


def test_constant_forest():
    x = np.zeros((3, len(FEATURES)))
    assert np.allclose(trees.constant(0.3).scores(x), 0.3) and (trees.constant(0.0).scores(x) < 1e-5).all()
