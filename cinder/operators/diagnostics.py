"""Diagnostics: class balance, confusion summaries, climatologies, robust
scales, distributions, missing rates, covariate shift (G15-G27, C33).

Wide-to-long steps use ``stack`` (a generator on each row, no join); every
percentile uses :func:`ranking.exact_quantiles`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinder.operators.coarse import nan_to_null
from cinder.operators.ranking import exact_quantiles
from cinder.schema import CONFUSION_LABELS, PIXEL_KEY


def class_balance(df: DataFrame, label_col: str = "label", group_cols=()) -> DataFrame:
    """Counts of each class and of rows without a label, neg:pos ratio and
    positive percent of the labelled rows, in one aggregate."""
    label = F.col(label_col)
    g = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(label == 1).alias("n_pos"),
                                    F.count_if(label == 0).alias("n_neg"), F.count_if(label.isNull()).alias("n_null"))
    return g.select(*group_cols, "n_total", "n_pos", "n_neg", "n_null",
                    F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")).alias("neg_pos_ratio"),
                    F.try_divide(F.col("n_pos") * 100.0, F.col("n_pos") + F.col("n_neg")).alias("pct_pos"))


def confusion_by_year(df: DataFrame, label_col: str = "pred_obs", year_col: str = "year") -> DataFrame:
    """TP/FN/TN/FP/NA counts per year and percents over valid rows only."""
    p = df.groupBy(year_col).pivot(label_col, CONFUSION_LABELS).agg(F.count(F.lit(1)))
    p = p.select(year_col, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in CONFUSION_LABELS])
    valid = F.col("TP") + F.col("FN") + F.col("TN") + F.col("FP")
    out = p.withColumns({"n_total": valid + F.col("NA"), "n_valid": valid})
    for c in ["TP", "FN", "TN", "FP"]:
        out = out.withColumn(f"{c}_pct", F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n_valid")), F.lit(0.0)))
    return out


def climatology(df: DataFrame, value_cols, key=PIXEL_KEY) -> DataFrame:
    """Mean over all months ignoring NaN / nodata per pixel."""
    return df.groupBy(*key).agg(*[F.avg(nan_to_null(c)).alias(c) for c in value_cols])


def summer_means(df: DataFrame, value_cols, key=PIXEL_KEY, months=(6, 7, 8)) -> DataFrame:
    """June-August mean per pixel and year (month filter is pushed down)."""
    return (df.where(F.col("month").isin(list(months))).groupBy(*key, "year")
              .agg(*[F.avg(nan_to_null(c)).alias(c) for c in value_cols]))


def unpivot(df: DataFrame, ids, value_cols, name_col: str = "feature", value_col: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(value_cols), name_col, value_col)


def robust_scale(per_year: DataFrame, value_cols, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Per feature, the minimum over years of the 2nd percentile and the
    maximum over years of the 98th percentile."""
    long = unpivot(per_year.select("year", *value_cols), ["year"], value_cols)
    q = exact_quantiles(long, "value", [lo, hi], ["feature", "year"])
    return q.groupBy("feature").agg(F.min("q0").alias("vmin"), F.max("q1").alias("vmax"))


def box_stats(df: DataFrame, value_col: str, group_cols) -> DataFrame:
    """Min / quartiles / max per group (box-plot table)."""
    q = exact_quantiles(df, value_col, [0.0, 0.25, 0.5, 0.75, 1.0], group_cols)
    return q.select(*group_cols, F.col("q0").alias("min"), F.col("q1").alias("q1"), F.col("q2").alias("median"),
                    F.col("q3").alias("q3"), F.col("q4").alias("max"))


def hist_by_class(df: DataFrame, value_col: str, class_col: str, lo: float, width: float, nbins: int) -> DataFrame:
    """Fixed-width histogram per class with the share of the class in each
    bin (densities normalised within class); values outside go to the edge bins."""
    b = F.least(F.lit(nbins - 1), F.greatest(F.lit(0), F.floor((F.col(value_col) - lo) / width).cast("int")))
    h = df.where(F.col(value_col).isNotNull()).groupBy(class_col, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tot = h.groupBy(class_col).agg(F.sum("n").alias("_t"))
    return h.join(tot, class_col).select(
        class_col, "bin", (F.lit(lo) + F.col("bin") * width).alias("bin_start"), "n",
        (F.col("n") / F.col("_t")).alias("share"))


def density_by_class(df: DataFrame, value_cols, class_col: str, grid_points: int = 200, bins: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of each column within each class at ``grid_points`` places.

    Bandwidth ``sd * n^(-1/5)`` (sample deviation); the grid runs from ``cut`` bandwidths
    below the least value to as many above the greatest.  Values are counted in ``bins``
    equal bins between these ends first, so the kernel sums run over bins, not rows: two
    passes over the rows (ends, counts), both partial aggregates.  A class without spread
    in a column has no density there.  Returns ``feature, class_col, point, x, density``."""
    v = F.col("value").cast("double")
    long = unpivot(df, [class_col], value_cols).where(v.isNotNull() & ~F.isnan(v) & F.col(class_col).isNotNull())
    ends = long.groupBy("feature", class_col).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd"))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    ends = ends.where("sd > 0").select("feature", class_col, "n", h.alias("h"), (F.col("lo") - cut * h).alias("lo"), (F.col("hi") + cut * h).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    # The middle of the range lies on a side of two bins: rounding must not choose between them.
    at = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / width + F.lit(1e-9)).cast("int"))
    counts = (long.join(ends, ["feature", class_col]).groupBy("feature", class_col, at.alias("bin")).agg(F.count(F.lit(1)).alias("c")))
    held = counts.groupBy("feature", class_col).agg(F.collect_list(F.struct("bin", "c")).alias("held"))      # at most ``bins`` entries
    grid = ends.join(held, ["feature", class_col]).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))))
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / F.lit(float(grid_points - 1))
    grid = grid.withColumns({"x": x, "w": width})

    def kernel(b: Column) -> Column:
        z = (F.col("x") - (F.col("lo") + (b["bin"] + 0.5) * F.col("w"))) / F.col("h")
        return b["c"] * F.exp(-0.5 * z * z)

    total = F.aggregate(F.transform("held", kernel), F.lit(0.0), lambda a, k: a + k)
    return grid.select("feature", class_col, "point", "x", (total / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def missing_rate(df: DataFrame, cols) -> DataFrame:
    """Share of NULL (or NaN) per column, long form."""
    aggs = [F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in cols]
    wide = df.agg(*aggs)
    return unpivot(wide, [], cols, "column", "missing_rate")


def covariate_shift(df: DataFrame, features, split_col: str = "split", train: str = "train",
                    test: str = "test", flag_pct: float = 10.0) -> DataFrame:
    """Clip each feature to the train [p1 - 10% range, p99 + 10% range],
    compare clipped means of test vs train, flag shifts above 10%.  A feature without
    a value in the train part has no row."""
    fit = unpivot(df.where(F.col(split_col) == train).select(*features), [], features)
    bounds = exact_quantiles(fit, "value", [0.01, 0.99], ["feature"])
    bounds = bounds.select("feature", (F.col("q0") - (F.col("q1") - F.col("q0")) * 0.1).alias("xmin"),
                           (F.col("q1") + (F.col("q1") - F.col("q0")) * 0.1).alias("xmax"))
    # one entry per feature, as a map: the rows are neither unpivoted again nor joined
    listed = bounds.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("xmin", "xmax"))))).scalar()
    rows = df.select(split_col, *features).withColumn("_bounds", listed)
    bound = lambda f: F.try_element_at("_bounds", F.lit(f))
    clipped = lambda f: F.when(bound(f).isNotNull() & F.col(f).isNotNull(),
                               F.greatest(bound(f)["xmin"], F.least(bound(f)["xmax"], F.col(f))))
    mean = lambda f, part: F.avg(F.when(F.col(split_col) == part, clipped(f)))
    wide = rows.agg(*[F.struct(F.lit(f).alias("feature"), F.first(bound(f)["xmin"], True).alias("xmin"),
                               F.first(bound(f)["xmax"], True).alias("xmax"), mean(f, train).alias("mean_train"),
                               mean(f, test).alias("mean_test")).alias(f"_{i}") for i, f in enumerate(features)])
    m = wide.select(F.inline(F.array(*[f"_{i}" for i in range(len(features))])))
    diff = (F.col("mean_test") - F.col("mean_train")) / (F.col("mean_train") + 1e-6) * 100
    return m.where("xmin IS NOT NULL").withColumns({"diff_pct": diff, "shifted": F.abs(diff) > flag_pct})


def unique_burned_pixels(df: DataFrame, label_col: str = "label", key=PIXEL_KEY) -> DataFrame:
    """Distinct burned pixels per year across months (distinct, then count)."""
    return (df.where(F.col(label_col) == 1).select("year", *key).distinct()
              .groupBy("year").agg(F.count(F.lit(1)).alias("unique_burned_pixels")))


def obs_vs_pred_by_year(df: DataFrame, obs_col: str, pred_col: str) -> DataFrame:
    """Observed vs predicted positive counts per year."""
    return df.groupBy("year").agg(F.sum(obs_col).cast("bigint").alias("obs_pixels"),
                                  F.sum(pred_col).cast("bigint").alias("pred_pixels"))
