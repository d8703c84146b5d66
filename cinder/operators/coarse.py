"""Annual composites, coarse grids and the grid-size x threshold sweep
(G1-G7, B5, B6, H1-H3).

Scale notes
-----------
* Every aggregate is one ``groupBy`` with partial (map-side) aggregation.
* The sweep (G6) aggregates pixels to 1 degree cells once; a k degree cell is a
  union of 1 degree cells (``floor(floor(x)/k) == floor(x/k)`` for integer k),
  so the other sizes re-aggregate the small cell table, never the pixels.
* Thresholds are exploded on the cell table (<= 64,800 cells per year and
  size), not on pixels.
* Cell ids (H1) use a window partitioned by (year, grid_deg): one partition
  holds at most the number of cells of one year at one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinder.operators.geometry import snap
from cinder.schema import (CELL_BURN_THRESHOLD, COARSE_MAX, COARSE_MIN, COARSE_MODE, FEATURES,
                           PIXEL_BURN_THRESHOLD, PIXEL_KEY, SWEEP_EPS)


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def annual_composite(df: DataFrame, features=FEATURES, key=PIXEL_KEY, keep=("longitude", "latitude"),
                     fraction_col: str = "fraction") -> DataFrame:
    """G1: per pixel and year, NaN-skipping max of ``fraction`` and mean of each
    predictor (mode, lowest code on ties, for categorical ``b1``)."""
    aggs = [F.max(nan_to_null(fraction_col)).alias(fraction_col)]
    for f in features:
        if f in COARSE_MODE:
            aggs.append(F.mode(nan_to_null(f), True).alias(f))
        else:
            aggs.append(F.avg(nan_to_null(f)).alias(f))
    aggs += [F.first(c).alias(c) for c in keep]
    return df.groupBy(*key, "year").agg(*aggs)


def coarse_rule(name: str, rules: str = "analytical") -> str:
    """Aggregation rule of one predictor: 'mode', 'min', 'max' or 'mean'.

    ``rules='analytical'`` is the per-column rule table (G2); ``'mean'`` is the
    earlier variant with mean for all but ``b1`` (G3)."""
    if name in COARSE_MODE:
        return "mode"
    if rules == "mean":
        return "mean"
    if name in COARSE_MIN:
        return "min"
    if name in COARSE_MAX:
        return "max"
    return "mean"


def coarse_grid(annual: DataFrame, size_deg: float = 1.0, burned_threshold: float = CELL_BURN_THRESHOLD,
                features=FEATURES, rules: str = "analytical", fraction_col: str = "fraction",
                lon_col: str = "longitude", lat_col: str = "latitude") -> DataFrame:
    """Coarse cells per year with burned share, mean fraction,
    per-column predictor rules, ``burned_label`` and a dense ``ID`` ordered by
    (big_lat, big_lon) within (year, grid_deg).  Pixels with NULL fraction are
    not valid and do not enter any cell."""
    valid = annual.where(F.col(fraction_col).isNotNull())
    p = valid.select(
        "year", snap(lon_col, size_deg).alias("big_lon"), snap(lat_col, size_deg).alias("big_lat"),
        (F.col(fraction_col) > 0).cast("int").alias("_b"), F.col(fraction_col).alias("_f"),
        *[nan_to_null(f).alias(f) for f in features])
    aggs = [F.avg("_b").alias("burned_frac_4km"), F.avg("_f").alias("frac_4km")]
    for f in features:
        rule = coarse_rule(f, rules)
        fn = {"mode": lambda c: F.mode(c, True), "min": F.min, "max": F.max, "mean": F.avg}[rule]
        aggs.append(fn(F.col(f)).alias(f))
    g = p.groupBy("year", "big_lon", "big_lat").agg(*aggs)
    w = Window.partitionBy("year", "grid_deg").orderBy("big_lat", "big_lon")
    g = g.withColumns({
        "burned_label": (F.col("burned_frac_4km") >= F.lit(float(burned_threshold))).cast("int"),
        "grid_deg": F.lit(size_deg),
    })
    return g.withColumn("ID", (F.row_number().over(w) - 1).cast("bigint"))


def sweep_thresholds(n: int = 10, start: float = 0.05, step: float = 0.05) -> Column:
    """``start + i*step`` for i in 0..n-1, computed in DOUBLE like ``arange``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.lit(start) + i.cast("double") * F.lit(step))


def grid_param_sweep(annual: DataFrame, sizes=range(1, 11), thresholds: Column | None = None,
                     pixel_threshold: float = PIXEL_BURN_THRESHOLD, fraction_col: str = "fraction",
                     lon_col: str = "longitude", lat_col: str = "latitude") -> DataFrame:
    """Per (year, grid size, threshold) pixel-level TP/FP/FN with precision,
    recall, F1 and IoU (epsilon 1e-7) when a cell is labelled burned if its
    burned share >= threshold."""
    thresholds = thresholds if thresholds is not None else sweep_thresholds()
    valid = annual.where(F.col(fraction_col).isNotNull())
    cells1 = valid.groupBy(
        "year", F.floor(F.col(lon_col).cast("double")).alias("c_lon"),
        F.floor(F.col(lat_col).cast("double")).alias("c_lat")).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum((F.col(fraction_col) > pixel_threshold).cast("int")).alias("n_burned"))
    sizes_arr = F.array(*[F.lit(int(s)) for s in sizes])
    cells = (cells1.withColumn("grid_size_deg", F.explode(sizes_arr))
                   .groupBy("year", "grid_size_deg",
                            F.floor(F.col("c_lon") / F.col("grid_size_deg")).alias("k_lon"),
                            F.floor(F.col("c_lat") / F.col("grid_size_deg")).alias("k_lat"))
                   .agg(F.sum("n_total").alias("n_total"), F.sum("n_burned").alias("n_burned")))
    cells = cells.withColumn("frac", F.col("n_burned") / F.col("n_total"))
    ct = cells.withColumn("threshold", F.explode(thresholds))
    pred = F.col("frac") >= F.col("threshold")
    g = ct.groupBy("year", "grid_size_deg", "threshold").agg(
        F.sum(F.when(pred, F.col("n_burned")).otherwise(0)).alias("TP"),
        F.sum(F.when(pred, F.col("n_total") - F.col("n_burned")).otherwise(0)).alias("FP"),
        F.sum(F.when(~pred, F.col("n_burned")).otherwise(0)).alias("FN"))
    return with_sweep_metrics(g)


def with_sweep_metrics(g: DataFrame, eps: float = SWEEP_EPS) -> DataFrame:
    tp, fp, fn = (F.col(c).cast("double") for c in ("TP", "FP", "FN"))
    prec = tp / (tp + fp + F.lit(eps))
    rec = tp / (tp + fn + F.lit(eps))
    return g.withColumns({
        "Precision": prec, "Recall": rec,
        "F1_Score": 2 * (prec * rec) / (prec + rec + F.lit(eps)),
        "IoU": tp / (tp + fp + fn + F.lit(eps))})


def grid_param_avg(sweep: DataFrame) -> DataFrame:
    """Mean of each metric over years per (grid size, threshold)."""
    return sweep.groupBy("grid_size_deg", "threshold").agg(
        *[F.avg(c).alias(c) for c in ("F1_Score", "IoU", "Precision", "Recall", "TP", "FP", "FN")])


def best_row(df: DataFrame, order: list[str], tie_cols: list[str], where: Column | None = None,
             n: int = 1) -> DataFrame:
    """H2/H3: top row(s) by ``order`` descending, ties broken by ``tie_cols``
    ascending; optional candidate filter.  ``limit`` here is the feature (a
    top-1 choice over a small metrics table)."""
    d = df.where(where) if where is not None else df
    # metrics are compared at 9 places so last-bit noise does not break ties
    return d.orderBy(*[F.round(F.col(c), 9).desc() for c in order],
                     *[F.col(c).asc() for c in tie_cols]).limit(n)
