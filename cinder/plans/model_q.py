"""Model queries (L1-L17, K9, K11, E9, C28, H4).  Rows-only checks: MLlib
training has no SQL twin.  Every query trains on the full pixel-month table
derived from the given tables; the driver loops over models only."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Window
from pyspark.sql import functions as F

from cinder.functions.cleaning import clean_training
from cinder.functions.hashing import hash32
from cinder.functions.labels import confusion_label
from cinder.operators.coarse import annual_composite, coarse_grid
from cinder.operators import logistic, trees
from cinder.operators.boosting import Spec, fit_groups
from cinder.operators.geometry import coord_to_cell
from cinder.operators.masks import prob_rescale
from cinder.operators.metrics import (area_match_threshold, confusion_metrics, counts_summary, curve_summary, metrics_at_thresholds, pr_curve,
                                      quantile_at, regression_metrics, score_counts, threshold_choice)
from cinder.operators.models import (BAGS, DEPENDENCE_FEATURES, DEPENDENCE_POINTS, MIN_INSTANCES, PERMUTATION_REPEATS, VALIDATION,
                                     auc_pr_evaluator, category_indexer, class_ratio, class_weight_col, feature_stages, fit_many, fit_pipeline,
                                     gbt_classifier, gbt_regressor, logistic_pipeline, prepare, score, with_category_string,
                                     with_validation)
from cinder.operators.ranking import bucketed_rank, exact_quantiles
from cinder.operators.sampling import class_guard, kfold_assign, loyo_folds, role_in_fold
from cinder.plans.common import obs
from cinder.plans.registry import query
from cinder.plans.sqlgen import rnd, round_doubles
from cinder.schema import FEATURES, PIXEL_BURN_THRESHOLD
from cinder.session import checkpoint_dir, cut_lineage, scratch_path
from cinder.sources.files import input_stamp
from cinder.sources.tables import read_table, with_obs

KEY = ["grid_row", "grid_col", "year", "month"]
LABEL = "burned_pixel"
TEST_YEARS = [1999, 2000]
NUMERIC = [f for f in FEATURES if f != "b1"]
_CACHE: dict = {}


def _kept_by(spark, name: str, sf: str) -> tuple:
    """What a table or model is kept under: its name, the session's folder, and the files it is derived from."""
    stamps = tuple(input_stamp(spark, f"{sf.rstrip('/')}/{t}.parquet") for t in ("lineitem", "part"))
    return name, sf, checkpoint_dir(spark), stamps


def _materialised(spark, name: str, sf: str, build):
    """Build once per state of the input files and cut lineage with a reliable checkpoint in
    the shared checkpoint folder (every fit re-reads it many times)."""
    k = _kept_by(spark, name, sf)
    if k not in _CACHE:
        _CACHE[k] = cut_lineage(build())
    return _CACHE[k]


def training_table(spark, sf):
    """Cleaned pixel-months with the strict ternary label (0.5 rows dropped); ``is_val``
    marks the rows that boosting only watches."""
    return _materialised(spark, "train", sf, lambda: with_validation(clean_training(obs(spark, sf)).select(
        *KEY, "zone_id", "fraction", *FEATURES, LABEL), KEY, LABEL))


def _draws(grid: list[dict], n: int, salt: str) -> list[dict]:
    """Reproducible 'random' draws from a parameter list (hash order)."""
    key = lambda p: hashlib.md5(f"{salt}_{sorted(p.items())}".encode()).hexdigest()
    return sorted(grid, key=key)[:n]


@query("fixed_categories", with_obs(
    "SELECT b1, CASE WHEN rint_b1 BETWEEN 0 AND 99 THEN rint_b1 ELSE 100 END AS b1_idx, count(*) AS n "
    "FROM (SELECT b1, CAST(round_even(b1, 0) AS DOUBLE) AS rint_b1 FROM obs) t GROUP BY 1, 2"))
def q_fixed_categories(spark, sf):
    """One fixed land-cover dictionary; unseen codes map to the extra bucket."""
    o = with_category_string(obs(spark, sf))
    idx = category_indexer().transform(o)
    return idx.groupBy("b1", "b1_idx").agg(F.count(F.lit(1)).alias("n"))


def _cells(spark, sf):
    return _materialised(spark, "cells", sf, lambda: with_validation(
        coarse_grid(annual_composite(obs(spark, sf)), 1.0)
        .withColumn("burned_label", F.col("burned_label").cast("double")), ["year", "ID"], "burned_label"))


# --- searches: every draw and fold is a model of one grouped fit ---
STAGE1_GRID = [dict(depth=d, step=s, rows=r, columns=c, l2=l, positive_weight=w)
               for d in (2, 3, 4) for s in (0.05, 0.1, 0.2) for r in (0.6, 0.8, 1.0) for c in (0.6, 0.8, 1.0)
               for l in (0.1, 1.0, 5.0) for w in (0.5, 1.0, 2.0, 4.0)]
STAGE1_DRAWS, STAGE1_FOLDS = 30, 5
PATIENT = dict(rounds=10_000, patience=200, least_improvement=0.0)     # of the watched rows' loss: the reference's stage-1 search


def _out_of_fold(df, label: str, draws: list[dict], k: int, keys):
    """(rows with fold, model, p) scored by models that left the row's fold out, and the fits by
    (draw, fold).  Every draw and fold is fitted in one grouped fit; ``is_val`` rows are watched."""
    folds = cut_lineage(kfold_assign(df, keys, k, label))
    fit = folds.withColumns({f"fit_{i}": F.when(F.col("fold") == i, 0).when(F.col("is_val"), 2).otherwise(1) for i in range(k)})
    specs = {f"{j}_{i}": Spec(f"fit_{i}", **d) for j, d in enumerate(draws) for i in range(k)}
    fits = fit_groups(fit, label, specs, keys, **PATIENT)
    forests = {i: {str(j): fits[f"{j}_{i}"].forest for j in range(len(draws))} for i in range(k)}
    s = trees.score_models_by_key(folds, forests, "fold").select(label, "fold", F.explode("scores").alias("s"))
    return s.select(label, "fold", F.col("s.model").cast("int").alias("draw"), F.col("s.p").alias("p")), fits


def _search(spark, draws: list[dict], fits: dict, k: int, judged, value: str):
    """A row a draw: its parameters, the mean of ``judged`` (draw, fold, value) and of the rounds kept."""
    rounds = [sum(fits[f"{j}_{i}"].rounds for i in range(k)) / k for j in range(len(draws))]
    rows = [(j, *[float(v) for v in d.values()], r) for j, (d, r) in enumerate(zip(draws, rounds))]
    drawn = spark.createDataFrame(rows, "draw int, " + ", ".join(f"{n} double" for n in draws[0]) + ", mean_rounds double")
    return drawn.join(judged.groupBy("draw").agg(F.avg(value).alias(f"mean_{value}")), "draw", "left")


def _recall(s, label: str, groups):
    hit = (F.col("p") >= 0.5) & (F.col(label) == 1)
    return s.groupBy(*groups).agg(F.try_divide(F.count_if(hit).cast("double"), F.count_if(F.col(label) == 1)).alias("recall"),
                                  F.count(F.lit(1)).alias("n"))


@query("stage1_train")
def q_stage1_train(spark, sf):
    """L1: stage-1 cell model: 30 hashed draws x 5 folds in one grouped fit, selected by recall."""
    draws = _draws(STAGE1_GRID, STAGE1_DRAWS, "stage1")
    s, fits = _out_of_fold(_cells(spark, sf), "burned_label", draws, STAGE1_FOLDS, ["year", "ID"])
    return _search(spark, draws, fits, STAGE1_FOLDS, _recall(s, "burned_label", ["draw", "fold"]), "recall")


def _stage1_model(spark, sf):
    k = _kept_by(spark, "stage1", sf)
    if k not in _CACHE:
        cells = _cells(spark, sf)
        m = fit_pipeline(cells, gbt_classifier("burned_label", min_instances=5, subsample=1.0))
        path, metrics = scratch_path(spark, "stage1_model"), scratch_path(spark, "stage1_metrics")
        m.write().overwrite().save(path)                       # D10: persisted pipeline
        area_match_threshold(score(m, cells.where("is_val")), "burned_label", "p").write.json(metrics)
        _CACHE[k] = path, metrics
    path, metrics = _CACHE[k]
    return PipelineModel.load(path), float(spark.read.json(metrics).first()["threshold"])


@query("stage1_score")
def q_stage1_score(spark, sf):
    """L2: score every cell with the saved stage-1 model; label at the threshold saved
    with it (area match on the rows that the fit did not see)."""
    model, threshold = _stage1_model(spark, sf)
    s = score(model, _cells(spark, sf))
    s = s.withColumns({"pred_prob": F.col("p"), "pred_label": (F.col("p") >= threshold).cast("int")})
    return s.select("year", "ID", "pred_prob", "pred_label",
                    confusion_label(F.col("burned_label").cast("int"), "pred_label").alias("pred_obs"))


STOP = dict(patience=10, least_improvement=1e-3)      # of the watched rows' loss; the reference waits 200 rounds
LOYO = dict(depth=4, step=0.3, least_weight=100.0, least_gain=5.0, rows=0.5, columns=0.5)


def _loyo_models(spark, sf, weighted: bool):
    """L3/L4: (model, threshold) by held-out year: fitted to the other years' 'train' rows,
    boosted until their 'val' rows gain nothing; threshold = area match on those.  The
    weighted (n_neg / n_pos) and unweighted models of all years are one grouped fit."""
    k = _kept_by(spark, "loyo", sf)
    if k not in _CACHE:
        t = training_table(spark, sf)
        folds = cut_lineage(loyo_folds(t, KEY, label_col=LABEL))
        by_year = {r["year"]: (r["n"], r["p"]) for r in folds.groupBy("year").agg(      # a few rows
            F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("p")).collect()}
        n, p = (sum(v[i] for v in by_year.values()) for i in (0, 1))
        role = lambda y: F.when(role_in_fold(y) == "train", 1).when(role_in_fold(y) == "val", 2).otherwise(0)
        fit = folds.withColumns({f"fit_{y}": role(y) for y in by_year}).drop("roles")
        specs = {}
        for y, (ny, py) in sorted(by_year.items()):
            ratio = (n - ny - p + py) / (p - py) if p > py else 1.0
            specs |= {f"weighted_{y}": Spec(f"fit_{y}", positive_weight=ratio, **LOYO), f"plain_{y}": Spec(f"fit_{y}", **LOYO)}
        fits = fit_groups(fit, LABEL, specs, KEY, **STOP)
        s = trees.score_models(folds, {m: f.forest for m, f in fits.items()}).select(LABEL, "roles", F.explode("scores").alias("s"))
        of = F.split("s.model", "_")
        seen = F.exists("roles", lambda r: (r["fold_year"] == of[1].cast("int")) & (r["role"] == "val"))
        val = s.where(seen).select(LABEL, F.col("s.model").alias("model"),
                                   F.when(of[0] == "plain", prob_rescale("s.p")).otherwise(F.col("s.p")).alias("p"))
        limits = {r["model"]: float(r["threshold"]) for r in area_match_threshold(val, LABEL, "p", ["model"]).collect()}
        _CACHE[k] = {m: (f.forest, limits[m], f.rounds) for m, f in fits.items()}
    kind = "weighted" if weighted else "plain"
    return {int(m.split("_")[1]): v[:2] for m, v in _CACHE[k].items() if m.startswith(kind)}


def _scored_by_year(spark, sf, weighted: bool):
    """Every row with the score of its own year's model and that model's threshold: one scan."""
    models = _loyo_models(spark, sf, weighted)
    s = trees.score_by_key(training_table(spark, sf), {y: f for y, (f, _) in models.items()}, "year")
    limits = F.create_map(*[F.lit(v) for y, (_, t) in sorted(models.items()) for v in (y, t)])
    return (s if weighted else s.withColumn("p", prob_rescale("p"))).withColumn("threshold", F.try_element_at(limits, F.col("year")))


def _loyo_summary(spark, sf, weighted: bool):
    s = _scored_by_year(spark, sf, weighted)
    return s.groupBy(F.col("year").alias("test_year")).agg(
        F.sum(LABEL).cast("bigint").alias("tabular_obs_pixels"),
        F.sum((F.col("p") >= F.col("threshold")).cast("int")).cast("bigint").alias("tabular_pred_pixels"),
        F.sum("p").alias("expected_pixels"), F.first("threshold").alias("val_threshold"))


@query("stage2_loyo")
def q_stage2_loyo(spark, sf):
    """L3 / K8: weighted (n_neg/n_pos) LOYO models, area-match thresholds, counts."""
    return _loyo_summary(spark, sf, True)


@query("stage2_unweighted")
def q_stage2_unweighted(spark, sf):
    """Unweighted LOYO models; probabilities odds-rescaled before thresholds."""
    return _loyo_summary(spark, sf, False)


@query("loyo_score")
def q_loyo_score(spark, sf):
    """Every month scored by its year's model (node tables by year, one scan of the
    months); counts per (year, month)."""
    s = _scored_by_year(spark, sf, True)
    return s.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("p") >= F.col("threshold")).cast("int")).cast("bigint").alias("n_pred"))


def _temporal(spark, sf):
    t = training_table(spark, sf)
    return t.where(~F.col("year").isin(TEST_YEARS)), t.where(F.col("year").isin(TEST_YEARS))


@query("fraction_regression")
def q_fraction_regression(spark, sf):
    """Weighted fraction regression (non-zero fractions up-weighted, cap 100)."""
    train, test = _temporal(spark, sf)
    r = train.select((F.sum((F.col("fraction") == 0).cast("int")) / F.sum((F.col("fraction") > 0).cast("int"))).alias("r")).scalar()
    train = train.withColumn("w", F.when(F.col("fraction") > 0, F.least(F.lit(100.0), r)).otherwise(F.lit(1.0)))
    m = fit_pipeline(train, gbt_regressor("fraction", "w"))
    out = [score(m, d).withColumn("split", F.lit(n)) for n, d in (("train", train.drop("w")), ("test", test))]
    u = out[0].unionByName(out[1])
    return regression_metrics(u, "fraction", "prediction", ["split"])


@query("fraction_regression_grid")
def q_fraction_regression_grid(spark, sf):
    """Fraction regression with a grid search (3-fold CV on RMSE)."""
    train, _ = _temporal(spark, sf)
    gbt = gbt_regressor("fraction")
    pipe = Pipeline(stages=feature_stages() + [gbt])
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, [3, 5]).build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, numFolds=3, foldCol="fold", parallelism=4,
                        evaluator=RegressionEvaluator(labelCol="fraction", metricName="rmse"))
    m = cv.fit(prepare(cut_lineage(kfold_assign(train, KEY, 3, LABEL))))
    return spark.createDataFrame([(3, float(m.avgMetrics[0])), (5, float(m.avgMetrics[1]))],
                                 "maxDepth int, mean_rmse double")


SEARCH_GRID = [{"maxDepth": d, "minInstancesPerNode": m} for d in (3, 4, 5) for m in (20, 100)]


@query("random_search")
def q_random_search(spark, sf):
    """Hashed random search scored by average precision (area under PR), 3-fold."""
    train, _ = _temporal(spark, sf)
    gbt = gbt_classifier(LABEL, subsample=1.0)
    pipe = Pipeline(stages=feature_stages() + [gbt])
    draws = _draws(SEARCH_GRID, 2, "search")
    maps = [{gbt.maxDepth: d["maxDepth"], gbt.minInstancesPerNode: d["minInstancesPerNode"]} for d in draws]
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=auc_pr_evaluator(LABEL),
                        numFolds=3, foldCol="fold", parallelism=4)
    m = cv.fit(prepare(cut_lineage(kfold_assign(train, KEY, 3, LABEL))))
    rows = [(d["maxDepth"], d["minInstancesPerNode"], float(v)) for d, v in zip(draws, m.avgMetrics)]
    return spark.createDataFrame(rows, "maxDepth int, minInstancesPerNode int, mean_average_precision double")


RATIOS = list(range(1, 11))             # negatives for each positive


@query("logreg_by_zone")
def q_logreg_by_zone(spark, sf):
    """A standardised L2 logistic model for every zone and negative:positive ratio, all in
    one grouped fit, land cover as an indicator for each code; max-F1 threshold on the
    validation rows, metrics on the zone's fixed test rows.  Zones with one class are left out."""
    t = training_table(spark, sf)
    t = t.join(class_guard(t, ["zone_id"], LABEL), "zone_id")
    d = cut_lineage(logistic.ratio_roles(t, "zone_id", KEY, LABEL, RATIOS).where("role is not null"))
    codes = {"b1": logistic.indicator_columns(d, "b1")}
    x = logistic.design(FEATURES, codes)
    fit = logistic.fit_groups(d.where("role = 'train'"), "zone_id", LABEL, x, F.col("from_ratio"), len(RATIOS))
    s = logistic.score_groups(d.where("role <> 'train'"), logistic.model_table(spark, fit, "zone_id"), "zone_id", x)
    g = ["zone_id", "m"]
    judged = s.where((F.col("role") == "test") | (F.col("from_ratio") <= F.col("m"))).select(*g, "role", LABEL, "p")
    chosen = threshold_choice(pr_curve(judged.where("role = 'val'"), LABEL, "p", g), "max_f1", group_cols=g).select(
        *g, "threshold", F.col("f1").alias("val_f1"))
    test = judged.where("role = 'test'")
    hit, y = F.col("p") >= F.col("threshold"), F.col(LABEL) == 1
    at = confusion_metrics(test.join(chosen, g).groupBy(*g, "threshold", "val_f1").agg(
        F.count_if(hit & y).alias("TP"), F.count_if(hit & ~y).alias("FP"), F.count_if(~hit & y).alias("FN"))).drop("TP", "FP", "FN")
    auc = curve_summary(test, LABEL, "p", g).withColumnsRenamed({"n_pos": "n_pos_test", "n_neg": "n_neg_test"})
    first = F.explode(F.sequence(F.col("from_ratio"), F.lit(len(RATIOS) - 1))).alias("m")
    n = lambda role, label: F.count_if((F.col("role") == role) & (F.col(LABEL) == label)).alias(f"n_{('neg', 'pos')[label]}_{role}")
    sizes = d.where("role <> 'test'").select("zone_id", first, "role", LABEL, "n_pos_tv", "n_neg_tv").groupBy(*g).agg(
        F.first("n_pos_tv").alias("n_pos_tv"), F.first("n_neg_tv").alias("n_neg_tv"),
        *[n(role, label) for role in ("train", "val") for label in (1, 0)])
    ratio = F.get(F.array(*map(F.lit, RATIOS)), F.col("m"))
    got = sizes.withColumns({"neg_pos_ratio": ratio, "eff_neg_pos_ratio": F.least(ratio * F.col("n_pos_tv"), F.col("n_neg_tv")) / F.col("n_pos_tv")})
    return got.join(at, g).join(auc, g).drop("m")


@query("balanced_bagging")
def q_balanced_bagging(spark, sf):
    """Balanced bags -> models -> averaged probability.  A row's bags are bits of one
    number: all bags for a positive, for a negative those whose draw (a hash of the key and
    the bag) is below n_pos / n_neg.  All models score the test rows in one scan.  A bag with
    fewer rows to fit than two children need cannot be split: its trees are leaves, and
    boosting ends at its base rate (of an empty bag: that of all rows)."""
    train, test = _temporal(spark, sf)
    share = train.select(F.try_divide(F.sum(LABEL), F.sum(1 - F.col(LABEL)))).scalar()          # scalar subquery
    draw = lambda b: F.pmod(F.xxhash64(F.lit(b), *KEY), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bits = reduce(lambda a, c: a.bitwiseOR(c), [
        F.when((F.col(LABEL) == 1) | (draw(b) < share), F.lit(1 << b)).otherwise(F.lit(0)) for b in range(BAGS)])
    bags = cut_lineage(train.withColumn("bags", bits))
    inside = lambda b: F.col("bags").bitwiseAND(F.lit(1 << b)) != 0
    fitted = bags.where(~F.col(VALIDATION))
    sizes = fitted.select(F.avg(LABEL).alias("rate"), *[a.alias(f"{n}{b}") for b in range(BAGS) for n, a in (
        ("n", F.count_if(inside(b))), ("p", F.count_if(inside(b) & (F.col(LABEL) == 1))))]).first()      # one row

    def fit_one(b, _):
        n, p = sizes[f"n{b}"], sizes[f"p{b}"]
        if n < 2 * MIN_INSTANCES:
            base = p / n if n else sizes["rate"]
            return trees.constant(0.5 if base is None else base)
        path = scratch_path(spark, f"bag_{b}")
        fit_pipeline(bags.where(inside(b)), gbt_classifier(LABEL)).write().overwrite().save(path)
        return trees.load(spark, path)

    forests = fit_many({b: None for b in range(BAGS)}, fit_one)
    s = trees.score_models(test, {str(b): f for b, f in forests.items()})
    p = F.aggregate("scores", F.lit(0.0), lambda a, v: a + v["p"]) / F.lit(float(BAGS))
    return curve_summary(s.select("year", LABEL, p.alias("p")), LABEL, "p", ["year"])


@query("class_weight_sweep")
def q_class_weight_sweep(spark, sf):
    """Positive class weight sweep (1, 10, n_neg/n_pos)."""
    train, test = _temporal(spark, sf)
    ratio = train.select(class_ratio(LABEL).alias("r")).first()["r"]   # one value

    def fit_one(_, w):
        tw = train.withColumn("w", F.when(F.col(LABEL) == 1, F.lit(float(w))).otherwise(1.0))
        m = logistic_pipeline(LABEL, FEATURES, weight_col="w").fit(prepare(tw))
        s = m.transform(prepare(test)).withColumn("p", vector_to_array("probability")[1])
        return metrics_at_thresholds(s, LABEL, "p", [0.5]).withColumn("pos_weight", F.lit(float(w)))

    res = fit_many(dict(enumerate((1.0, 10.0, float(ratio)))), fit_one)    # the ratio may equal another weight
    return reduce(lambda a, b: a.unionByName(b), res.values())


def _save_global(spark, sf) -> str:
    """Where the all-years model is saved."""
    k = _kept_by(spark, "global", sf)
    if k not in _CACHE:
        t = class_weight_col(training_table(spark, sf), LABEL)
        m = fit_pipeline(t, gbt_classifier(LABEL, "w"))
        path = scratch_path(spark, "global_model")
        m.write().overwrite().save(path)
        _CACHE[k] = path
    return _CACHE[k]


def _global_model(spark, sf):
    return PipelineModel.load(_save_global(spark, sf))


def _save_past(spark, sf) -> str:
    """Where the model of all years but the test years is saved, for what is judged on those."""
    k = _kept_by(spark, "past", sf)
    if k not in _CACHE:
        train, _ = _temporal(spark, sf)
        path = scratch_path(spark, "past_model")
        fit_pipeline(class_weight_col(train, LABEL), gbt_classifier(LABEL, "w")).write().overwrite().save(path)
        _CACHE[k] = path
    return _CACHE[k]


@query("stage2_ranked")
def q_stage2_ranked(spark, sf):
    """The 'ranking' variant is a binary model; threshold = percentile of
    test scores at the training prevalence."""
    train, test = _temporal(spark, sf)
    m = fit_pipeline(train, gbt_classifier(LABEL))
    prev = train.select(F.avg(LABEL)).scalar()   # scalar subquery
    s = score(m, test)
    thr = quantile_at(s, "p", spark.range(1).select((1 - prev).alias("prob")), []).first()["quantile"]
    j = s.withColumn("quantile", F.lit(thr))   # one value
    return j.groupBy("year").agg(F.sum(LABEL).cast("bigint").alias("obs_pixels"),
                                 F.sum((F.col("p") >= F.col("quantile")).cast("int")).cast("bigint").alias("pred_pixels"),
                                 F.first("quantile").alias("threshold"))


@query("top_features")
def q_top_features(spark, sf):
    """Normalised gain importances, top 6 (top-k is the feature)."""
    m = _global_model(spark, sf)
    imp = m.stages[-1].featureImportances.toArray().tolist()
    names = NUMERIC + ["b1"]
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(6)


@query("global_model")
def q_global_model(spark, sf):
    """All-years weighted model; in-sample AUC / AP per year."""
    s = score(_global_model(spark, sf), training_table(spark, sf))
    return curve_summary(s, LABEL, "p", ["year"])


@query("batch_score")
def q_batch_score(spark, sf):
    """Every pixel-month scored by several saved models (the global one and each
    leave-one-year-out one) in one scan; probability and class by each model's threshold,
    summarised per (model, year, month)."""
    models = {"global": (trees.load(spark, _save_global(spark, sf)), 0.5)}
    models |= {f"without_{y}": m for y, m in sorted(_loyo_models(spark, sf, True).items())}
    s = trees.score_models(obs(spark, sf).select(*KEY, *FEATURES), {n: f for n, (f, _) in models.items()})
    limits = F.create_map(*[F.lit(v) for n, (_, t) in models.items() for v in (n, float(t))])
    each = s.select("year", "month", F.explode("scores").alias("s")).select(
        F.col("s.model").alias("model"), "year", "month", F.col("s.p").alias("p"))
    return each.groupBy("model", "year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_prob"),
        F.sum((F.col("p") >= F.try_element_at(limits, F.col("model"))).cast("int")).cast("bigint").alias("n_pred"))


# --- a second product on its own grid: cells of 0.4 degrees, not a multiple of the pixels ---
ALT = {"x0": -150.1, "dx": 0.4, "y0": 65.15, "dy": -0.4, "width": 26, "height": 14}


def _second_product(spark, sf):
    """Burned fraction per cell and month of the second product, from the orders alone."""
    o = read_table(spark, sf, "orders").where("o_orderdate is not null")
    return o.groupBy(
        ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % ALT["height"]).cast("int").alias("alt_row"),
        (F.col("o_custkey") % ALT["width"]).cast("int").alias("alt_col"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("alt_fraction"))


def _on_second_product(spark, sf, pixels):
    """``pixels`` with the label of the second product's cell that holds the pixel's centre,
    same year and month; pixels outside its grid or without a value there are left out."""
    at = coord_to_cell(pixels, "longitude", "latitude", ALT["x0"], ALT["dx"], ALT["y0"], ALT["dy"], ALT["width"], ALT["height"],
                       "alt_row", "alt_col")
    return at.join(_second_product(spark, sf), ["alt_row", "alt_col", "year", "month"]).withColumn(
        "alt_label", (F.col("alt_fraction") > PIXEL_BURN_THRESHOLD).cast("int"))


_ALT_SQL = f"""
alt AS (SELECT CAST((o_custkey * 7 + o_orderkey) % {ALT["height"]} AS INTEGER) AS alt_row, CAST(o_custkey % {ALT["width"]} AS INTEGER) AS alt_col,
               CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
               avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus IS NOT NULL THEN 0.0 END) AS alt_fraction
        FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2, 3, 4),
onto AS (SELECT o.*, alt.alt_fraction, CAST(alt.alt_fraction > {PIXEL_BURN_THRESHOLD} AS INTEGER) AS alt_label
         FROM obs o JOIN alt ON alt.year = o.year AND alt.month = o.month
          AND alt.alt_row = CAST(floor((latitude - {ALT["y0"]}) / ({ALT["dy"]})) AS INTEGER)
          AND alt.alt_col = CAST(floor((longitude - ({ALT["x0"]})) / {ALT["dx"]}) AS INTEGER))"""


@query("transfer_labels", with_obs(f"""
SELECT year, count(*) AS n, CAST(sum(alt_label) AS BIGINT) AS n_alt, CAST(sum(label) AS BIGINT) AS n_own,
       CAST(sum(label * alt_label) AS BIGINT) AS n_both, {rnd('avg(alt_fraction)')} AS mean_alt_fraction
FROM onto GROUP BY year""", _ALT_SQL))
def q_transfer_labels(spark, sf):
    """A second product on its own grid snapped to the pixels of the first: pixels, labels and agreement by year."""
    j = _on_second_product(spark, sf, obs(spark, sf))
    return round_doubles(j.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("alt_label").cast("bigint").alias("n_alt"), F.sum("label").cast("bigint").alias("n_own"),
        F.sum(F.col("label") * F.col("alt_label")).cast("bigint").alias("n_both"), F.avg("alt_fraction").alias("mean_alt_fraction")))


@query("transfer_score")
def q_transfer_score(spark, sf):
    """The model of the first product's years up to 1997, applied to the later years and
    judged by the labels of a second product, which come from other tables on another grid."""
    t = training_table(spark, sf)
    m = fit_pipeline(t.where("year <= 1997"), gbt_classifier(LABEL))
    own = obs(spark, sf).where("year > 1997").select(*KEY, "longitude", "latitude", *FEATURES)
    return metrics_at_thresholds(score(m, _on_second_product(spark, sf, own)), "alt_label", "p", [0.5], ["year"])


@query("best_iteration")
def q_best_iteration(spark, sf):
    """K9: IoU of every prefix of the boosted ensemble on years outside the fit; argmax."""
    _, test = _temporal(spark, sf)
    r = trees.prefix_metrics(test, trees.load(spark, _save_past(spark, sf)), LABEL)
    return r.withColumn("is_best", F.col("iteration") == r.orderBy(F.col("iou").desc(), "iteration")
                        .select("iteration").limit(1).scalar())


@query("oof_scores")
def q_oof_scores(spark, sf):
    """Stratified 5-fold out-of-fold probabilities; recall per fold."""
    s, _ = _out_of_fold(_cells(spark, sf), "burned_label", [dict(rows=0.8)], 5, ["year", "ID"])
    return _recall(s, "burned_label", ["fold"])


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    """AUC drop on years outside the fit when one feature is permuted, for every
    feature; a repeat pairs the row ranks of two hash orders (bucketed ranks, no
    global sort).  All repeats are paired at once, one scan of the pairs scores every
    feature's variant, and the counts by score are written before the curves."""
    forest = trees.load(spark, _save_past(spark, sf))
    _, test = _temporal(spark, sf)
    orders = F.explode(F.array(*[F.struct(F.lit(rep).alias("repeat"), hash32(f"pa{rep}", *KEY).alias("_ha"), hash32(f"pb{rep}", *KEY).alias("_hb"))
                                 for rep in range(PERMUTATION_REPEATS)]))
    rows = test.select(*KEY, LABEL, *FEATURES, orders.alias("_o")).select(*KEY, LABEL, *FEATURES, "_o.*")

    def ranked(h):
        return bucketed_rank(rows, ["repeat"], F.col(h), KEY, out="_r", bucket=F.shiftright(h, 16))

    pairs = ranked("_ha").select("repeat", "_r", LABEL, *FEATURES).join(
        ranked("_hb").select("repeat", "_r", *[F.col(f).alias(f"_v_{f}") for f in FEATURES]), ["repeat", "_r"])
    s = trees.score_replaced(pairs, forest, "_v_").select("repeat", LABEL, F.explode("scores").alias("s")).select(
        "repeat", "s.feature", LABEL, "s.p")
    auc = counts_summary(cut_lineage(score_counts(s, LABEL, "p", ["repeat", "feature"])), ["repeat", "feature"])
    base = F.max(F.when(F.col("feature") == "", F.col("roc_auc"))).over(Window.partitionBy("repeat"))      # a row a feature
    return auc.select("feature", "repeat", base.alias("base_auc"), F.col("roc_auc").alias("permuted_auc"),
                      (base - F.col("roc_auc")).alias("auc_drop")).where("feature <> ''")


@query("partial_dependence")
def q_partial_dependence(spark, sf):
    """Partial dependence in log-odds of the most important features, over grids of 30 and 50
    quantiles.  Rows that reach each leaf with one feature left free are counted in one
    pass; no row is copied for a grid point, and the values are those of replacing the
    feature in every row."""
    model, t = _global_model(spark, sf), training_table(spark, sf)
    forest = trees.load(spark, _save_global(spark, sf))
    gain = dict(zip(forest.names, model.stages[-1].featureImportances.toArray().tolist()))
    top = sorted(gain, key=lambda f: (-gain[f], f))[:DEPENDENCE_FEATURES]
    places = {n: [i / (n - 1) for i in range(n)] for n in DEPENDENCE_POINTS}
    probs = sorted({p for at in places.values() for p in at})
    long = t.unpivot([], top, "feature", "value")
    held = {r["feature"]: dict(zip(probs, list(r)[1:])) for r in exact_quantiles(long, "value", probs, ["feature"]).collect()}   # top rows
    grids = {(f, n): sorted({float(held[f][p]) for p in at}) for f in top for n, at in places.items()}
    every = {f: sorted({v for n in places for v in grids[f, n]}) for f in top}
    margin = {f: dict(zip(every[f], m)) for f, m in trees.partial_dependence(t, forest, every).items()}
    rows = [(f, n, v, float(2 * margin[f][v])) for (f, n), grid in grids.items() for v in grid]
    return spark.createDataFrame(rows, "feature string, grid_points int, grid_value double, mean_logodds double")
