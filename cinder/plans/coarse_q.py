"""Queries for annual composites, coarse grids and the grid parameter sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinder.operators.coarse import (annual_composite, best_row, coarse_grid, grid_param_avg,
                                     grid_param_sweep)
from cinder.operators.geometry import snap
from cinder.plans.common import obs
from cinder.plans.registry import query
from cinder.plans.sqlgen import PYK, annual_composite_ctes, coarse_grid_ctes, rnd, round_doubles
from cinder.schema import FEATURES
from cinder.sources.tables import with_obs

AC_COLS = ["fraction", *FEATURES, "longitude", "latitude"]


def _ac(spark, sf):
    return annual_composite(obs(spark, sf))


@query("annual_composite", with_obs(
    f"SELECT {PYK}, " + ", ".join(f"{rnd(c)} AS {c}" for c in AC_COLS) + " FROM ac",
    annual_composite_ctes()))
def q_annual_composite(spark, sf):
    return round_doubles(_ac(spark, sf))


CG_COLS_D = ["big_lon", "big_lat", "burned_frac_4km", "frac_4km", *FEATURES, "grid_deg"]
CG_SELECT = "SELECT year, ID, burned_label, " + ", ".join(f"{rnd(c)} AS {c}" for c in CG_COLS_D) + " FROM cg"


@query("coarse_grid", with_obs(CG_SELECT, annual_composite_ctes() + ",\n" + coarse_grid_ctes()))
def q_coarse_grid(spark, sf):
    return round_doubles(coarse_grid(_ac(spark, sf), 1.0, 0.05))


@query("coarse_grid_mean", with_obs(CG_SELECT, annual_composite_ctes() + ",\n"
                                    + coarse_grid_ctes(size=2.0, thr=0.15, rules="mean")))
def q_coarse_grid_mean(spark, sf):
    return round_doubles(coarse_grid(_ac(spark, sf), 2.0, 0.15, rules="mean"))


SWEEP_CTES = annual_composite_ctes() + """,
px AS (SELECT year, longitude, latitude, CAST(fraction > 0.5 AS INTEGER) AS b FROM ac WHERE fraction IS NOT NULL),
sz AS (SELECT CAST(s AS INTEGER) AS grid_size_deg FROM range(1, 11) t(s)),
cells AS (SELECT year, grid_size_deg, floor(longitude / grid_size_deg) AS kx, floor(latitude / grid_size_deg) AS ky,
                 count(*) AS n_total, sum(b) AS n_burned FROM px, sz GROUP BY 1, 2, 3, 4),
th AS (SELECT CAST(0.05 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) AS threshold FROM range(0, 10) t(i)),
sw0 AS (SELECT year, grid_size_deg, threshold,
               sum(CASE WHEN n_burned / n_total >= threshold THEN n_burned ELSE 0 END) AS TP,
               sum(CASE WHEN n_burned / n_total >= threshold THEN n_total - n_burned ELSE 0 END) AS FP,
               sum(CASE WHEN n_burned / n_total >= threshold THEN 0 ELSE n_burned END) AS FN
        FROM cells, th GROUP BY 1, 2, 3),
sw AS (SELECT *, TP / (TP + FP + 1e-7) AS Precision, TP / (TP + FN + 1e-7) AS Recall,
              TP / (TP + FP + FN + 1e-7) AS IoU FROM sw0),
swm AS (SELECT *, 2 * (Precision * Recall) / (Precision + Recall + 1e-7) AS F1_Score FROM sw)"""
METRICS = ["Precision", "Recall", "F1_Score", "IoU"]


def _sweep(spark, sf):
    return grid_param_sweep(_ac(spark, sf))


@query("grid_param_sweep", with_obs(
    "SELECT year, grid_size_deg, CAST(TP AS BIGINT) AS TP, CAST(FP AS BIGINT) AS FP, CAST(FN AS BIGINT) AS FN, "
    + ", ".join(f"{rnd(c)} AS {c}" for c in ["threshold", *METRICS]) + " FROM swm", SWEEP_CTES))
def q_grid_param_sweep(spark, sf):
    return round_doubles(_sweep(spark, sf))


AVG_CTE = SWEEP_CTES + """,
av AS (SELECT grid_size_deg, threshold, avg(F1_Score) AS F1_Score, avg(IoU) AS IoU, avg(Precision) AS Precision,
              avg(Recall) AS Recall, avg(TP) AS TP, avg(FP) AS FP, avg(FN) AS FN FROM swm GROUP BY 1, 2)"""
AVG_COLS = ["threshold", "F1_Score", "IoU", "Precision", "Recall", "TP", "FP", "FN"]


@query("grid_param_avg", with_obs(
    "SELECT grid_size_deg, " + ", ".join(f"{rnd(c)} AS {c}" for c in AVG_COLS) + " FROM av", AVG_CTE))
def q_grid_param_avg(spark, sf):
    return round_doubles(grid_param_avg(_sweep(spark, sf)))


@query("smart_grid_choice", with_obs(
    "SELECT grid_size_deg, " + ", ".join(f"{rnd(c)} AS {c}" for c in AVG_COLS)
    + " FROM av WHERE Recall >= 0.9 ORDER BY round(Precision, 9) DESC, grid_size_deg, threshold LIMIT 1", AVG_CTE))
def q_smart_grid_choice(spark, sf):
    """H3: best precision with mean recall >= 0.90 (top-1 is the feature)."""
    avg = grid_param_avg(_sweep(spark, sf))
    return round_doubles(best_row(avg, ["Precision"], ["grid_size_deg", "threshold"], F.col("Recall") >= 0.9))


@query("best_threshold_row", with_obs(
    "SELECT grid_size_deg, " + ", ".join(f"{rnd(c)} AS {c}" for c in AVG_COLS)
    + " FROM av ORDER BY round(Recall, 9) DESC, round(Precision, 9) DESC, round(F1_Score, 9) DESC, grid_size_deg, threshold LIMIT 1", AVG_CTE))
def q_best_threshold_row(spark, sf):
    """H2: best row by (recall, precision, f1) descending, threshold as final tie key."""
    avg = grid_param_avg(_sweep(spark, sf))
    return round_doubles(best_row(avg, ["Recall", "Precision", "F1_Score"], ["grid_size_deg", "threshold"]))


@query("best_threshold_row_by_f1", with_obs(
    "SELECT grid_size_deg, " + ", ".join(f"{rnd(c)} AS {c}" for c in AVG_COLS)
    + " FROM av ORDER BY round(F1_Score, 9) DESC, round(IoU, 9) DESC, round(Precision, 9) DESC, grid_size_deg, threshold LIMIT 1", AVG_CTE))
def q_best_threshold_row_by_f1(spark, sf):
    """H2, second order: best row by (f1, iou, precision) descending."""
    avg = grid_param_avg(_sweep(spark, sf))
    return round_doubles(best_row(avg, ["F1_Score", "IoU", "Precision"], ["grid_size_deg", "threshold"]))


@query("cell_ids", with_obs(
    "SELECT year, ID, " + rnd("big_lon") + " AS big_lon, " + rnd("big_lat") + " AS big_lat FROM cg",
    annual_composite_ctes() + ",\n" + coarse_grid_ctes()))
def q_cell_ids(spark, sf):
    """H1: dense sequential cell ID per year ordered by (lat, lon)."""
    return round_doubles(coarse_grid(_ac(spark, sf), 1.0).select("year", "ID", "big_lon", "big_lat"))


@query("distinct_units", with_obs(
    "SELECT DISTINCT year, CAST(s AS INTEGER) AS grid_size_deg FROM obs, range(1, 4) t(s)"))
def q_distinct_units(spark, sf):
    """Distinct (year, grid size) units to process."""
    o = obs(spark, sf).select("year").distinct()
    return o.select("year", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("grid_size_deg")).distinct()


@query("coarse_snap", with_obs(
    "SELECT grid_row, grid_col, " + rnd("5.0 * floor(longitude / 5.0)") + " AS big_lon, "
    + rnd("5.0 * floor(latitude / 5.0)") + " AS big_lat FROM (SELECT DISTINCT grid_row, grid_col, longitude, latitude FROM obs)"))
def q_coarse_snap(spark, sf):
    """Snap pixel centres to a 5 degree grid."""
    o = obs(spark, sf).select("grid_row", "grid_col", "longitude", "latitude").distinct()
    return round_doubles(o.select("grid_row", "grid_col", snap("longitude", 5.0).alias("big_lon"),
                                  snap("latitude", 5.0).alias("big_lat")))
