"""Queries for metrics, curves and thresholds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinder.operators.masks import annual_max, area_multi_threshold
from cinder.operators.metrics import (area_match_threshold, curve_summary, focal_terms,
                                      leave_out_area_match, metrics_at_thresholds, pr_curve, quantile_at,
                                      regression_metrics, threshold_choice, weighted_logloss)
from cinder.operators.geometry import geographic_pixel_area_m2
from cinder.plans.common import AREA_SQL, obs
from cinder.plans.registry import query
from cinder.plans.sqlgen import rnd, round_doubles
from cinder.sources.tables import GRID_DX, GRID_DY, with_obs

NOISY_SQL = "label * CAST(0.35 AS DOUBLE) + u_score * CAST(0.65 AS DOUBLE)"
S_CTE = f"s AS (SELECT grid_row, grid_col, year, month, label, fraction, {NOISY_SQL} AS p FROM obs)"


def _scored(spark, sf):
    """Observed label with an overlapping synthetic score ``p``."""
    o = obs(spark, sf)
    return o.withColumn("p", F.col("label") * 0.35 + F.col("u_score") * 0.65)


T9 = [round(0.1 * i, 1) for i in range(1, 10)]
T19 = [round(0.05 * i, 2) for i in range(1, 20)]
MET = ["precision", "recall", "f1", "iou"]


def _metrics_sql(thresholds, group: str) -> str:
    arr = "[" + ", ".join(repr(t) for t in thresholds) + "]::DOUBLE[]"
    gsel = f"{group}, " if group else ""
    return with_obs(f"""
SELECT {gsel}{rnd('threshold')} AS threshold, TP, FP, FN, TN,
       {rnd('coalesce(TP / nullif(TP + FP, 0), 0.0)')} AS precision,
       {rnd('coalesce(TP / nullif(TP + FN, 0), 0.0)')} AS recall,
       {rnd('coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0.0)')} AS f1,
       {rnd('coalesce(TP / nullif(TP + FP + FN, 0), 0.0)')} AS iou
FROM (SELECT {gsel}threshold,
        CAST(sum(CASE WHEN p >= threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
        CAST(sum(CASE WHEN p >= threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
        CAST(sum(CASE WHEN p < threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FN,
        CAST(sum(CASE WHEN p < threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN
      FROM s, (SELECT unnest({arr}) AS threshold) th GROUP BY {gsel}threshold) c""", S_CTE)


@query("metrics_at_threshold", _metrics_sql(T9, "year"))
def q_metrics_at_threshold(spark, sf):
    """K1: precision / recall / F1 / IoU per year at thresholds 0.1..0.9."""
    m = metrics_at_thresholds(_scored(spark, sf), "label", "p", T9, ["year"])
    return round_doubles(m)


@query("threshold_table", _metrics_sql(T19, ""))
def q_threshold_table(spark, sf):
    """K2: the 0.05..0.95 grid over all rows."""
    return round_doubles(metrics_at_thresholds(_scored(spark, sf), "label", "p", T19))


PR_CTES = S_CTE + """,
sc AS (SELECT year, p AS score, CAST(sum(label) AS BIGINT) AS tp, CAST(sum(1 - label) AS BIGINT) AS fp FROM s GROUP BY 1, 2),
pr AS (SELECT year, score AS threshold, tp, fp,
              sum(tp) OVER (PARTITION BY year ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp_cum,
              sum(fp) OVER (PARTITION BY year ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp_cum,
              sum(tp) OVER (PARTITION BY year) AS P FROM sc),
prm AS (SELECT *, coalesce(tp_cum / nullif(tp_cum + fp_cum, 0), 0.0) AS precision,
               coalesce(tp_cum / nullif(P, 0), 0.0) AS recall FROM pr),
prf AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM prm)"""


def _pr(spark, sf):
    return pr_curve(_scored(spark, sf), "label", "p", ["year"])


@query("pr_curve", with_obs(
    f"SELECT year, {rnd('threshold')} AS threshold, tp, fp, CAST(tp_cum AS BIGINT) AS tp_cum, "
    f"CAST(fp_cum AS BIGINT) AS fp_cum, {rnd('precision')} AS precision, {rnd('recall')} AS recall FROM prm", PR_CTES))
def q_pr_curve(spark, sf):
    """H5: precision-recall curve per year, one point per distinct score."""
    return round_doubles(_pr(spark, sf).drop("P"))


@query("roc_auc", with_obs(f"""
SELECT year, {rnd('sum(fp * (2.0 * tp_cum - tp) / 2.0) / (any_value(P) * any_value(N))')} AS roc_auc
FROM (SELECT *, sum(fp) OVER (PARTITION BY year) AS N FROM pr) t GROUP BY year""", PR_CTES))
def q_roc_auc(spark, sf):
    """H6: ROC AUC per year (trapezoid over distinct scores)."""
    return round_doubles(curve_summary(_scored(spark, sf), "label", "p", ["year"]).select("year", "roc_auc"))


@query("average_precision", with_obs(f"""
SELECT year, {rnd('sum(tp * precision) / any_value(P)')} AS average_precision FROM prm GROUP BY year""", PR_CTES))
def q_average_precision(spark, sf):
    """Average precision per year."""
    return round_doubles(curve_summary(_scored(spark, sf), "label", "p", ["year"]).select("year", "average_precision"))


_MODELS = ["score", "u_score", "fire_weather_index"]


@query("average_precision_by_model", with_obs(f"""
SELECT model, year, {rnd('sum(tp * tp_cum / (tp_cum + fp_cum)) / nullif(sum(tp), 0)')} AS average_precision,
       CAST(rank() OVER (PARTITION BY year ORDER BY {rnd('sum(tp * tp_cum / (tp_cum + fp_cum)) / nullif(sum(tp), 0)')} DESC, model) AS INTEGER) AS place
FROM (SELECT *, sum(tp) OVER w AS tp_cum, sum(fp) OVER w AS fp_cum
      FROM (SELECT model, year, p, sum(label) AS tp, sum(1 - label) AS fp
            FROM (UNPIVOT (SELECT year, label, {', '.join(_MODELS)} FROM obs) ON {', '.join(_MODELS)} INTO NAME model VALUE p) u GROUP BY 1, 2, 3) c
      WINDOW w AS (PARTITION BY model, year ORDER BY p DESC)) t
GROUP BY model, year"""))
def q_average_precision_by_model(spark, sf):
    """The scores of several models side by side: average precision by model and year, ranked within the year."""
    long = obs(spark, sf).unpivot(["year", "label"], _MODELS, "model", "p")
    ap = round_doubles(curve_summary(long, "label", "p", ["model", "year"]).select("model", "year", "average_precision"))
    by = Window.partitionBy("year").orderBy(F.col("average_precision").desc(), "model")        # a row for each model
    return ap.withColumn("place", F.rank().over(by))


def _choice_sql(order: str) -> str:
    return with_obs(f"""
SELECT year, {rnd('threshold')} AS threshold, {rnd('precision')} AS precision, {rnd('recall')} AS recall, {rnd('f1')} AS f1
FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {order}, threshold DESC) AS rn FROM prf) t WHERE rn = 1""",
                    PR_CTES)


def _choice(spark, sf, rule):
    c = threshold_choice(_pr(spark, sf), rule, 0.8, ["year"])
    return round_doubles(c.select("year", "threshold", "precision", "recall", "f1"))


@query("thr_recall_floor", _choice_sql("CAST(recall >= 0.8 AS INTEGER) DESC, round(precision, 12) DESC"))
def q_thr_recall_floor(spark, sf):
    """K3: max precision with recall >= 0.80, else max precision."""
    return _choice(spark, sf, "recall_floor")


@query("thr_precision_floor", _choice_sql(
    "CAST(precision >= 0.8 AS INTEGER) DESC, round(CASE WHEN precision >= 0.8 THEN recall ELSE precision END, 12) DESC"))
def q_thr_precision_floor(spark, sf):
    """K4: max recall with precision >= 0.80, else max precision."""
    return _choice(spark, sf, "precision_floor")


@query("thr_max_f1", _choice_sql("1 DESC, round(f1, 12) DESC"))
def q_thr_max_f1(spark, sf):
    """K5: max F1 over the PR curve."""
    return _choice(spark, sf, "max_f1")


def _pct_sql(src: str, grp: str, prob_expr: str, out_where: str = "") -> str:
    """Linear-interpolation percentile of ``p`` per ``grp`` at ``prob_expr``."""
    return f"""
r AS (SELECT {grp}, p, row_number() OVER (PARTITION BY {grp} ORDER BY p) - 1 AS idx FROM {src}),
t AS (SELECT {grp}, count(*) AS n, sum(label) AS nb FROM {src} GROUP BY {grp}),
tp AS (SELECT *, (n - 1) * ({prob_expr}) AS pos FROM t),
q AS (SELECT tp.{grp}, tp.nb, lo.p + (tp.pos - floor(tp.pos)) * (hi.p - lo.p) AS quantile
      FROM tp JOIN r lo ON lo.{grp} = tp.{grp} AND lo.idx = floor(tp.pos)
              JOIN r hi ON hi.{grp} = tp.{grp} AND hi.idx = ceil(tp.pos))"""


@query("area_match_threshold", with_obs(
    f"SELECT year, {rnd('CASE WHEN nb = 0 THEN 0.99 ELSE quantile END')} AS threshold FROM q",
    S_CTE + "," + _pct_sql("s", "year", "1 - nb / n")))
def q_area_match_threshold(spark, sf):
    """Per-year threshold whose exceedance matches the burned share."""
    return round_doubles(area_match_threshold(_scored(spark, sf), "label", "p", ["year"]))


@query("prevalence_threshold", with_obs(
    f"SELECT {rnd('quantile')} AS threshold FROM q",
    S_CTE + """,
sv AS (SELECT sum(label) / count(*) AS prev FROM s WHERE year <= 1998),
st AS (SELECT 1 AS g, p, label FROM s WHERE year > 1998),""" + _pct_sql("st", "g", "1 - (SELECT prev FROM sv)")))
def q_prevalence_threshold(spark, sf):
    """K7: percentile of test scores at the validation prevalence (top-K area)."""
    s = _scored(spark, sf)
    prev = s.where("year <= 1998").select(F.sum("label") / F.count(F.lit(1))).scalar()
    test = s.where("year > 1998")
    probs = spark.range(1).select((1 - prev).alias("prob"))
    return round_doubles(quantile_at(test, "p", probs, []).select(F.col("quantile").alias("threshold")))


@query("loyo_summary", with_obs(f"""
SELECT y.year AS test_year, CAST(y.obs_n AS BIGINT) AS tabular_obs_pixels, CAST(y.pred_n AS BIGINT) AS tabular_pred_pixels,
       {rnd('y.expected')} AS expected_pixels, {rnd('q.val_threshold')} AS val_threshold,
       {rnd('coalesce((y.pred_n - y.obs_n) * 100.0 / nullif(y.obs_n, 0), 0.0)')} AS error_pct
FROM (SELECT s.year, sum(s.label) AS obs_n, sum(CASE WHEN s.p >= q.val_threshold THEN 1 ELSE 0 END) AS pred_n,
             sum(s.p) AS expected FROM s JOIN q ON s.year = q.fold_year GROUP BY s.year) y
JOIN q ON y.year = q.fold_year""", S_CTE + """,
f AS (SELECT ys.fy AS fold_year, s.p, s.label FROM s JOIN (SELECT DISTINCT year AS fy FROM s) ys ON s.year <> ys.fy),""" +
    _pct_sql("f", "fold_year", "1 - nb / n") + """,
q2 AS (SELECT fold_year, CASE WHEN nb = 0 THEN 0.99 ELSE quantile END AS val_threshold FROM q)""").replace(
    "JOIN q ON s.year = q.fold_year", "JOIN q2 q ON s.year = q.fold_year").replace(
    "JOIN q ON y.year = q.fold_year", "JOIN q2 q ON y.year = q.fold_year"))
def q_loyo_summary(spark, sf):
    """K8: per held-out year, area-match threshold from the other years, observed
    vs predicted pixel counts, expected count ``sum(p)`` and % error."""
    s = _scored(spark, sf)
    thr = leave_out_area_match(s, "label", "p", "year").withColumnRenamed("threshold", "val_threshold")
    j = s.join(thr, "year")
    y = j.groupBy("year", "val_threshold").agg(
        F.sum("label").alias("obs_n"), F.sum((F.col("p") >= F.col("val_threshold")).cast("int")).alias("pred_n"),
        F.sum("p").alias("expected"))
    return round_doubles(y.select(
        F.col("year").alias("test_year"), F.col("obs_n").cast("bigint").alias("tabular_obs_pixels"),
        F.col("pred_n").cast("bigint").alias("tabular_pred_pixels"), F.col("expected").alias("expected_pixels"),
        "val_threshold",
        F.coalesce(F.try_divide((F.col("pred_n") - F.col("obs_n")) * 100.0, F.col("obs_n")), F.lit(0.0))
        .alias("error_pct")))


@query("regression_metrics", with_obs(f"""
SELECT year, count(*) AS n, {rnd('sqrt(sum((y - q) * (y - q)) / count(*))')} AS rmse,
       {rnd('sum(abs(y - q)) / count(*)')} AS mae,
       {rnd('1 - sum((y - q) * (y - q)) / (sum(y * y) - sum(y) * sum(y) / count(*))')} AS r2
FROM (SELECT year, fraction AS y, fraction * CAST(0.5 AS DOUBLE) + u_score * CAST(0.5 AS DOUBLE) AS q FROM obs) t
GROUP BY year"""))
def q_regression_metrics(spark, sf):
    """RMSE / MAE / R2 of a fraction prediction per year."""
    o = obs(spark, sf).withColumn("q", F.col("fraction") * 0.5 + F.col("u_score") * 0.5)
    return round_doubles(regression_metrics(o, "fraction", "q", ["year"]))


_FOCAL_SQL = """
fx AS (SELECT year, label, greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-((p - 0.5) * 8))))) AS q,
              CAST(sum(1 - label) OVER (PARTITION BY year) AS DOUBLE) / count(*) OVER (PARTITION BY year) AS a_dyn FROM s),
fc AS (SELECT year, label, a_dyn, CASE WHEN label > 0.5 THEN q ELSE 1 - q END AS c,
  CASE WHEN label > 0.5 THEN 0.25 ELSE 0.75 END AS w, CASE WHEN label > 0.5 THEN a_dyn ELSE 1 - a_dyn END AS w_dyn FROM fx),
fz AS (SELECT year, label,
  CASE WHEN label > 0.5 THEN 1 ELSE -1 END * w * (2 * c * (1 - c) * (1 - c) * ln(c) - pow(1 - c, 3)) AS grad,
  w * c * (1 - c) * (1 - c) * ((1 - c) * (5 + 2 * ln(c)) - 4 * c * ln(c)) AS hess,
  -w * pow(1 - c, 2.0) * ln(c) AS loss, -w_dyn * pow(1 - c, 2.0) * ln(c) AS loss_dyn FROM fc)"""


@query("focal_terms", with_obs(
    f"SELECT year, label, {rnd('avg(grad)')} AS grad_mean, {rnd('avg(hess)')} AS hess_mean, "
    f"{rnd('avg(loss)')} AS loss_mean, {rnd('avg(loss_dyn)')} AS loss_dyn_mean FROM fz GROUP BY 1, 2",
    S_CTE + "," + _FOCAL_SQL))
def q_focal_terms(spark, sf):
    """Focal gradient / hessian / loss (alpha 0.25, gamma 2) and the loss
    with dynamic alpha = n_neg / n per year."""
    s = _scored(spark, sf)
    a = s.groupBy("year").agg((F.sum(1 - F.col("label")).cast("double") / F.count(F.lit(1))).alias("a_dyn"))
    s = s.join(a, "year")
    m = (F.col("p") - 0.5) * 8
    t = focal_terms(m, F.col("label"))
    td = focal_terms(m, F.col("label"), alpha=F.col("a_dyn"))
    return round_doubles(s.groupBy("year", "label").agg(
        F.avg(t["grad"]).alias("grad_mean"), F.avg(t["hess"]).alias("hess_mean"),
        F.avg(t["loss"]).alias("loss_mean"), F.avg(td["loss"]).alias("loss_dyn_mean")))


@query("weighted_logloss", with_obs(f"""
SELECT year, {rnd('sum(w * ll) / sum(w)')} AS weighted_logloss, {rnd('avg(ll)')} AS logloss FROM (
  SELECT year, CASE WHEN label > 0.5 THEN 10.0 ELSE 1.0 END AS w,
         -(label * ln(greatest(1e-7, least(1 - 1e-7, p))) + (1 - label) * ln(1 - greatest(1e-7, least(1 - 1e-7, p)))) AS ll
  FROM s) t GROUP BY year""", S_CTE))
def q_weighted_logloss(spark, sf):
    """Log-loss with x10 weight on positives."""
    return round_doubles(weighted_logloss(_scored(spark, sf), "label", "p", 10.0, ["year"]))


MT = [round(0.01 * i, 2) for i in range(1, 21)]
_AMAX_SQL = f"""am AS (SELECT grid_row, grid_col, year, max(p) AS amax, any_value({AREA_SQL}) AS area_m2
               FROM (SELECT *, {NOISY_SQL} AS p FROM obs) o GROUP BY 1, 2, 3)"""


def _area_multi(spark, sf):
    s = _scored(spark, sf)
    am = annual_max(s, "p")
    area = s.select("grid_row", "grid_col", geographic_pixel_area_m2("latitude", GRID_DX, GRID_DY).alias("area_m2")) \
        .dropDuplicates(["grid_row", "grid_col"])
    return area_multi_threshold(am.join(area, ["grid_row", "grid_col"]), "annual_max", "area_m2", MT, ["year"])


@query("area_multi_threshold", with_obs(
    f"SELECT year, {rnd('threshold')} AS threshold, {rnd('sum(CASE WHEN amax >= threshold THEN area_m2 ELSE 0.0 END) * 1e-4', 2)} "
    f"AS area_ha FROM am, (SELECT unnest([{', '.join(map(repr, MT))}]::DOUBLE[]) AS threshold) t GROUP BY 1, 2", _AMAX_SQL))
def q_area_multi_threshold(spark, sf):
    """Burned hectares per year for thresholds 0.01..0.20 from one pass
    over annual maxima."""
    a = _area_multi(spark, sf)
    return a.select("year", F.round(F.round("threshold", 10), 6).alias("threshold"),
                    F.round(F.round(F.col("area") * 1e-4, 10), 2).alias("area_ha"))


@query("threshold_slice", with_obs(
    f"SELECT year, {rnd('sum(CASE WHEN amax >= 0.05 THEN area_m2 ELSE 0.0 END) * 1e-4', 2)} AS area_ha "
    "FROM am GROUP BY year", _AMAX_SQL))
def q_threshold_slice(spark, sf):
    """One threshold's slice of the sensitivity table; absent -> error."""
    a = _area_multi(spark, sf)
    t = 0.05
    sl = a.where(F.abs(F.col("threshold") - t) < 1e-12)
    if sl.isEmpty():
        raise ValueError(f"threshold {t} not in sensitivity table")
    return sl.select("year", F.round(F.round(F.col("area") * 1e-4, 10), 2).alias("area_ha"))


@query("annual_max", with_obs(
    f"SELECT grid_row, grid_col, year, {rnd('max(' + NOISY_SQL + ')')} AS annual_max, "
    f"CAST(max({NOISY_SQL}) >= 0.9 AS INTEGER) AS burned FROM obs GROUP BY 1, 2, 3"))
def q_annual_max(spark, sf):
    """Annual maximum probability, then threshold."""
    am = annual_max(_scored(spark, sf), "p")
    return round_doubles(am.withColumn("burned", (F.col("annual_max") >= 0.9).cast("int")))
