"""MLlib models for the two-stage burned-area pipeline.

Training and scoring run as MLlib pipelines on the cluster; the driver only
loops over *models* (folds, years, bags, zones), never over rows.  Independent
fits are submitted from a small thread pool so Spark can run them side by side.

MLlib's GBT differs from LightGBM/XGBoost (no L1/L2 leaf penalties, no missing
value routing): metric values differ from the reference, the semantics (class
weights, regularisation, early stopping on a validation flag, per-fold models)
are kept.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinder.operators.sampling import stratified_split
from cinder.schema import CATEGORICAL, FEATURES

# --- fixed values: land-cover category dictionary used by every model --------
B1_CATEGORIES = [str(i) for i in range(0, 100)]
FIT_THREADS = 4
MAX_BINS = 128          # >= categories + 1 (unseen bucket) so b1 stays categorical
MAX_ROUNDS = 3000       # of boosting; a fit ends at the first round that does not lower the error of the
VALIDATION_TOL = 0.01  # validation rows (``VALIDATION``) by at least this share
VALIDATION = "is_val"
PERMUTATION_REPEATS = 5
DEPENDENCE_POINTS = (30, 50)
DEPENDENCE_FEATURES = 9
BAGS = 10
MIN_INSTANCES = 100


def category_indexer(col: str = "b1") -> StringIndexerModel:
    """One fixed category dictionary; unseen codes go to their own bucket."""
    return StringIndexerModel.from_labels(B1_CATEGORIES, inputCol=f"{col}_str", outputCol=f"{col}_idx",
                                          handleInvalid="keep")


def with_category_string(df: DataFrame, col: str = "b1") -> DataFrame:
    return df.withColumn(f"{col}_str", F.rint(F.nanvl(F.col(col).cast("double"), F.lit(None))).cast("int").cast("string"))


def feature_stages(features=FEATURES) -> list:
    numeric = [f for f in features if f not in CATEGORICAL]
    cats = [f for f in features if f in CATEGORICAL]
    stages = [category_indexer(c) for c in cats]
    stages.append(VectorAssembler(inputCols=numeric + [f"{c}_idx" for c in cats], outputCol="features",
                                  handleInvalid="keep"))
    return stages


def prepare(df: DataFrame, features=FEATURES) -> DataFrame:
    d = df
    for c in CATEGORICAL:
        if c in features:
            d = with_category_string(d, c)
    return d


def positive_prob(col: str = "probability") -> Column:
    return vector_to_array(F.col(col))[1]


def class_ratio(label_col: str) -> Column:
    """Aggregate: ``n_neg / max(1, n_pos)``, as the reference has it; 1 without negatives,
    where weights of 0 would leave nothing to fit."""
    neg, pos = F.sum(1 - F.col(label_col)), F.sum(F.col(label_col))
    return F.when(neg > 0, neg / F.greatest(pos, F.lit(1))).otherwise(F.lit(1.0))


def class_weight_col(df: DataFrame, label_col: str, out: str = "w") -> DataFrame:
    """``scale_pos_weight`` (``class_ratio``) as a weight column (positives)."""
    r = df.select(class_ratio(label_col).alias("r")).scalar()
    return df.withColumn(out, F.when(F.col(label_col) == 1, r).otherwise(F.lit(1.0)).cast("double"))


def gbt_classifier(label_col: str, weight_col: str | None = None, max_depth: int = 4, min_instances: int = MIN_INSTANCES,
                   subsample: float = 0.5, max_iter: int = MAX_ROUNDS, step: float = 0.1,
                   validation_col: str = VALIDATION, seed: int = 42) -> GBTClassifier:
    """L3 defaults: depth 4, min child 100, subsample 0.5; early stop on ``validation_col``."""
    g = GBTClassifier(labelCol=label_col, featuresCol="features", maxDepth=max_depth,
                      minInstancesPerNode=min_instances, subsamplingRate=subsample, maxIter=max_iter,
                      stepSize=step, seed=seed, maxBins=MAX_BINS, validationIndicatorCol=validation_col, validationTol=VALIDATION_TOL)
    return g.setWeightCol(weight_col) if weight_col else g


def with_validation(df: DataFrame, key_cols, label_col: str, share: float = 0.2) -> DataFrame:
    """``is_val``: a stratified hashed share of the rows, which boosting watches and does not fit."""
    d = stratified_split(df, key_cols, label_col, test_frac=share, salt="early")
    return d.withColumn(VALIDATION, F.col("role") == "test").drop("role")


def fit_pipeline(train: DataFrame, estimator, features=FEATURES) -> PipelineModel:
    return Pipeline(stages=feature_stages(features) + [estimator]).fit(prepare(train, features))


def score(model: PipelineModel, df: DataFrame, features=FEATURES, prob_col: str = "p") -> DataFrame:
    out = model.transform(prepare(df, features))
    if "probability" in out.columns:
        out = out.withColumn(prob_col, positive_prob())
    return out.drop("features", "rawPrediction", "probability",
                    *[f"{c}_str" for c in CATEGORICAL], *[f"{c}_idx" for c in CATEGORICAL])


def fit_many(jobs: dict, fn) -> dict:
    """Run independent fits from a small driver thread pool."""
    with ThreadPoolExecutor(max_workers=FIT_THREADS) as ex:
        futs = {k: ex.submit(fn, k, v) for k, v in jobs.items()}
        return {k: f.result() for k, f in futs.items()}


class RecallAtThreshold(Evaluator):
    """Recall of ``p >= threshold`` (stage-1 selection is recall-driven)."""

    def __init__(self, label_col: str = "label", threshold: float = 0.5):
        super().__init__()
        self.label_col, self.threshold = label_col, threshold

    def _evaluate(self, dataset: DataFrame) -> float:
        p = positive_prob() if "probability" in dataset.columns else F.col("p")
        r = dataset.select(F.sum(((p >= self.threshold) & (F.col(self.label_col) == 1)).cast("int")).alias("tp"),
                           F.sum(F.col(self.label_col)).alias("pos")).first()
        return float(r["tp"]) / float(r["pos"]) if r["pos"] else 0.0

    def isLargerBetter(self) -> bool:
        return True


def logistic_pipeline(label_col: str, features, reg: float = 0.01, weight_col: str | None = None) -> Pipeline:
    """Standardised L2 logistic regression; a categorical feature as an indicator for each code."""
    lr = LogisticRegression(labelCol=label_col, featuresCol="scaled", regParam=reg, elasticNetParam=0.0)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    cats = [f for f in features if f in CATEGORICAL]
    coded = [category_indexer(c) for c in cats]
    if cats:
        coded.append(OneHotEncoder(inputCols=[f"{c}_idx" for c in cats], outputCols=[f"{c}_hot" for c in cats], handleInvalid="keep"))
    inputs = [f for f in features if f not in cats] + [f"{c}_hot" for c in cats]
    return Pipeline(stages=[*coded, VectorAssembler(inputCols=inputs, outputCol="raw", handleInvalid="skip"),
                            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), lr])


def gbt_regressor(label_col: str, weight_col: str | None = None, max_depth: int = 4,
                  max_iter: int = MAX_ROUNDS, validation_col: str = VALIDATION) -> GBTRegressor:
    g = GBTRegressor(labelCol=label_col, featuresCol="features", maxDepth=max_depth, maxIter=max_iter, seed=42,
                     maxBins=MAX_BINS, validationIndicatorCol=validation_col, validationTol=VALIDATION_TOL)
    return g.setWeightCol(weight_col) if weight_col else g


def auc_pr_evaluator(label_col: str) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=label_col, rawPredictionCol="rawPrediction",
                                         metricName="areaUnderPR")
