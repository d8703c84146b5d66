"""Queries for diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinder.functions.labels import confusion_label, ternary_label
from cinder.operators.diagnostics import (box_stats, class_balance, climatology, confusion_by_year,
                                          covariate_shift, density_by_class, hist_by_class, missing_rate, obs_vs_pred_by_year,
                                          robust_scale, summer_means, unique_burned_pixels)
from cinder.plans.common import obs
from cinder.plans.registry import query
from cinder.plans.sqlgen import rnd, round_doubles
from cinder.schema import FEATURES
from cinder.sources.tables import with_obs

KEY = ["grid_row", "grid_col", "year", "month"]


@query("class_balance", with_obs(f"""
SELECT year, count(*) AS n_total, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
       count(*) FILTER (label IS NULL) AS n_null,
       {rnd('count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0)')} AS neg_pos_ratio,
       {rnd('count(*) FILTER (label = 1) * 100.0 / nullif(count(label), 0)')} AS pct_pos
FROM (SELECT year, CASE WHEN (grid_row * 7 + grid_col) % 13 <> 0 THEN label END AS label FROM obs) l GROUP BY year"""))
def q_class_balance(spark, sf):
    """Class counts, neg:pos ratio and positive share per year; some rows have no label."""
    o = obs(spark, sf).withColumn("label", F.when((F.col("grid_row") * 7 + F.col("grid_col")) % 13 != 0, F.col("label")))
    return round_doubles(class_balance(o, "label", ["year"]))


_CONF = """(SELECT year, CASE WHEN ol IS NULL OR pl IS NULL THEN 'NA' WHEN pl = 1 AND ol = 1 THEN 'TP'
   WHEN pl = 0 AND ol = 1 THEN 'FN' WHEN pl = 0 AND ol = 0 THEN 'TN' WHEN pl = 1 AND ol = 0 THEN 'FP' ELSE 'NA' END AS po
   FROM (SELECT year, CASE WHEN fraction > 0.5 THEN 1 WHEN fraction < 0.5 THEN 0 END AS ol,
                CAST(u_score > 0.5 AS INTEGER) AS pl FROM obs) a)"""


@query("confusion_by_year", with_obs(f"""
SELECT year, TP, FN, TN, FP, NA, TP + FN + TN + FP + NA AS n_total, TP + FN + TN + FP AS n_valid,
       {rnd('coalesce(TP * 100.0 / nullif(TP + FN + TN + FP, 0), 0.0)')} AS TP_pct,
       {rnd('coalesce(FN * 100.0 / nullif(TP + FN + TN + FP, 0), 0.0)')} AS FN_pct,
       {rnd('coalesce(TN * 100.0 / nullif(TP + FN + TN + FP, 0), 0.0)')} AS TN_pct,
       {rnd('coalesce(FP * 100.0 / nullif(TP + FN + TN + FP, 0), 0.0)')} AS FP_pct
FROM (SELECT year, count(*) FILTER (WHERE po = 'TP') AS TP, count(*) FILTER (WHERE po = 'FN') AS FN,
             count(*) FILTER (WHERE po = 'TN') AS TN, count(*) FILTER (WHERE po = 'FP') AS FP,
             count(*) FILTER (WHERE po = 'NA') AS NA FROM {_CONF} c GROUP BY year) t"""))
def q_confusion_by_year(spark, sf):
    """Stage-1 style confusion summary per year over valid rows."""
    o = obs(spark, sf)
    c = o.select("year", confusion_label(ternary_label("fraction"), (F.col("u_score") > 0.5).cast("int"))
                 .alias("pred_obs"))
    return round_doubles(confusion_by_year(c))


@query("climatology", with_obs(
    f"SELECT grid_row, grid_col, {', '.join(f'{rnd(f"avg({c})")} AS {c}' for c in FEATURES)} FROM obs GROUP BY 1, 2"))
def q_climatology(spark, sf):
    """Mean over all months per pixel (NaN skipped)."""
    return round_doubles(climatology(obs(spark, sf), FEATURES))


_SUMMER_SQL = (f"SELECT grid_row, grid_col, year, {', '.join(f'avg({c}) AS {c}' for c in FEATURES)} "
               "FROM obs WHERE month IN (6, 7, 8) GROUP BY 1, 2, 3")


@query("summer_means", with_obs(
    f"SELECT grid_row, grid_col, year, {', '.join(f'{rnd(c)} AS {c}' for c in FEATURES)} FROM ({_SUMMER_SQL}) t"))
def q_summer_means(spark, sf):
    """June-August means per pixel and year."""
    return round_doubles(summer_means(obs(spark, sf), FEATURES))


@query("robust_scale", with_obs(f"""
SELECT feature, {rnd('min(p2)')} AS vmin, {rnd('max(p98)')} AS vmax FROM (
  SELECT feature, year, quantile_cont(value, 0.02) AS p2, quantile_cont(value, 0.98) AS p98
  FROM (UNPIVOT ({_SUMMER_SQL}) ON {', '.join(FEATURES)} INTO NAME feature VALUE value) u
  GROUP BY 1, 2) t GROUP BY feature"""))
def q_robust_scale(spark, sf):
    """Global colour scale from yearly 2nd / 98th percentiles."""
    return round_doubles(robust_scale(summer_means(obs(spark, sf), FEATURES), FEATURES))


@query("box_stats", with_obs(f"""
SELECT label, {rnd('quantile_cont(temperature_2m, 0.0)')} AS min, {rnd('quantile_cont(temperature_2m, 0.25)')} AS q1,
       {rnd('quantile_cont(temperature_2m, 0.5)')} AS median, {rnd('quantile_cont(temperature_2m, 0.75)')} AS q3,
       {rnd('quantile_cont(temperature_2m, 1.0)')} AS max FROM obs GROUP BY label"""))
def q_box_stats(spark, sf):
    """Box-plot statistics of a predictor per class."""
    return round_doubles(box_stats(obs(spark, sf), "temperature_2m", ["label"]))


@query("hist_by_class", with_obs(f"""
SELECT label, bin, {rnd('260.0 + bin * 5.0')} AS bin_start, n, {rnd('n / sum(n) OVER (PARTITION BY label)')} AS share
FROM (SELECT label, CAST(least(9, greatest(0, floor((temperature_2m - 260.0) / 5.0))) AS INTEGER) AS bin, count(*) AS n
      FROM obs GROUP BY 1, 2) t"""))
def q_hist_by_class(spark, sf):
    """Fixed-width histogram normalised within class."""
    return round_doubles(hist_by_class(obs(spark, sf), "temperature_2m", "label", 260.0, 5.0, 10))


_DENSE = [f for f in FEATURES if f != "b1"]


@query("density_by_class", with_obs(f"""
SELECT feature, label, point, {rnd('x')} AS x, {rnd('sum(c * exp(-0.5 * power((x - (lo + (bin + 0.5) * w)) / h, 2)) / (n * h * sqrt(2 * pi())))')} AS density
FROM (SELECT e.*, c.bin, c.c, g.point, lo + g.point * (hi - lo) / 199.0 AS x, (hi - lo) / 512.0 AS w
      FROM e JOIN c USING (feature, label) CROSS JOIN (SELECT CAST(range AS INTEGER) AS point FROM range(200)) g) t
GROUP BY feature, label, point, x""", f"""
u AS (SELECT feature, label, value FROM (UNPIVOT (SELECT label, {', '.join(_DENSE)} FROM obs) ON {', '.join(_DENSE)} INTO NAME feature VALUE value) t),
s AS (SELECT feature, label, count(*) AS n, min(value) AS mn, max(value) AS mx, stddev_samp(value) * power(count(*), -0.2) AS h FROM u GROUP BY 1, 2),
e AS (SELECT feature, label, n, h, mn - 3 * h AS lo, mx + 3 * h AS hi FROM s WHERE h > 0),
c AS (SELECT u.feature, u.label, least(511, CAST(floor((value - lo) / ((hi - lo) / 512.0) + 1e-9) AS INTEGER)) AS bin, count(*) AS c
      FROM u JOIN e ON u.feature = e.feature AND u.label = e.label GROUP BY 1, 2, 3)"""))
def q_density_by_class(spark, sf):
    """Kernel density of every numeric predictor by class."""
    return round_doubles(density_by_class(obs(spark, sf), _DENSE, "label"))


_MISS = ["burned_pixel", "fwi", *FEATURES]
_MISS_SRC = ("(SELECT CASE WHEN fraction > 0.5 THEN 1.0 WHEN fraction < 0.5 THEN 0.0 END AS burned_pixel, "
             "CASE WHEN grid_col % 9 = 0 THEN NULL ELSE fire_weather_index END AS fwi, "
             f"{', '.join(FEATURES)} FROM obs)")


@query("missing_rate", with_obs(f"""
SELECT "column", {rnd('missing_rate')} AS missing_rate FROM (UNPIVOT (
  SELECT {', '.join(f'avg(CAST({c} IS NULL OR isnan({c}) AS DOUBLE)) AS {c}' for c in _MISS)} FROM {_MISS_SRC} s)
  ON {', '.join(_MISS)} INTO NAME "column" VALUE missing_rate) u"""))
def q_missing_rate(spark, sf):
    """Missing share per column."""
    o = obs(spark, sf).select(ternary_label("fraction").alias("burned_pixel"),
                              F.when(F.col("grid_col") % 9 != 0, F.col("fire_weather_index")).alias("fwi"), *FEATURES)
    return round_doubles(missing_rate(o, _MISS))


@query("obs_vs_pred_by_year", with_obs(
    "SELECT year, CAST(sum(label) AS BIGINT) AS obs_pixels, CAST(sum(CAST(u_score > 0.7 AS INTEGER)) AS BIGINT) "
    "AS pred_pixels FROM obs GROUP BY year"))
def q_obs_vs_pred_by_year(spark, sf):
    """Observed vs predicted positives per year."""
    o = obs(spark, sf).withColumn("pred", (F.col("u_score") > 0.7).cast("int"))
    return obs_vs_pred_by_year(o, "label", "pred")


@query("covariate_shift", with_obs(f"""
SELECT l.feature, {rnd('b.xmin')} AS xmin, {rnd('b.xmax')} AS xmax,
       {rnd("avg(CASE WHEN split = 'train' THEN greatest(b.xmin, least(b.xmax, value)) END)")} AS mean_train,
       {rnd("avg(CASE WHEN split = 'test' THEN greatest(b.xmin, least(b.xmax, value)) END)")} AS mean_test,
       {rnd("(avg(CASE WHEN split = 'test' THEN greatest(b.xmin, least(b.xmax, value)) END) - avg(CASE WHEN split = 'train' THEN greatest(b.xmin, least(b.xmax, value)) END)) / (avg(CASE WHEN split = 'train' THEN greatest(b.xmin, least(b.xmax, value)) END) + 1e-6) * 100")} AS diff_pct,
       abs((avg(CASE WHEN split = 'test' THEN greatest(b.xmin, least(b.xmax, value)) END) - avg(CASE WHEN split = 'train' THEN greatest(b.xmin, least(b.xmax, value)) END)) / (avg(CASE WHEN split = 'train' THEN greatest(b.xmin, least(b.xmax, value)) END) + 1e-6) * 100) > 10.0 AS shifted
FROM l JOIN b ON l.feature = b.feature GROUP BY l.feature, b.xmin, b.xmax""", f"""
l AS (UNPIVOT (SELECT CASE WHEN year IN (1999, 2000) THEN 'test' ELSE 'train' END AS split, {', '.join(FEATURES)} FROM obs)
      ON {', '.join(FEATURES)} INTO NAME feature VALUE value),
b0 AS (SELECT feature, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM l WHERE split = 'train' GROUP BY 1),
b AS (SELECT feature, p1 - (p99 - p1) * 0.1 AS xmin, p99 + (p99 - p1) * 0.1 AS xmax FROM b0)"""))
def q_covariate_shift(spark, sf):
    """Train-range clipping and mean-shift flags for test years."""
    o = obs(spark, sf).withColumn("split", F.when(F.col("year").isin(1999, 2000), "test").otherwise("train"))
    return round_doubles(covariate_shift(o, FEATURES))


@query("unique_burned_pixels", with_obs(
    "SELECT year, count(DISTINCT (grid_row, grid_col)) AS unique_burned_pixels FROM obs WHERE label = 1 GROUP BY year"))
def q_unique_burned_pixels(spark, sf):
    """Unique burned pixels per year across months."""
    return unique_burned_pixels(obs(spark, sf))
