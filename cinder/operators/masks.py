"""Annual masks and probability post-processing.

Monthly scores roll up to one row per (pixel, year) with a single grouped
aggregate; multi-threshold variants aggregate once on the annual maximum and
evaluate every threshold as a conditional sum, so the pixel table is never
multiplied by the number of thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinder.schema import PIXEL_KEY, RESCALE_K


def annual_max(df: DataFrame, value_col: str, key=PIXEL_KEY, year_col: str = "year",
               out_col: str = "annual_max") -> DataFrame:
    """NaN-skipping maximum of a monthly value per pixel and year."""
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*key, year_col).agg(F.max(v).alias(out_col))


def annual_mask(df: DataFrame, value_col: str, threshold: float | Column, key=PIXEL_KEY,
                year_col: str = "year", out_col: str = "burned") -> DataFrame:
    """1 if any month has ``value >= threshold``; NULL if no valid month.

    ``max(v) >= t`` equals ``OR_m (v_m >= t)``, so the threshold is applied after
    the aggregate and the same annual max serves every threshold.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    m = annual_max(df, value_col, key, year_col, "_amax")
    return m.select(*key, year_col, (F.col("_amax") >= t).cast("int").alias(out_col))


def annual_mask_dynamic(df: DataFrame, value_col: str, thresholds: DataFrame, key=PIXEL_KEY,
                        year_col: str = "year", out_col: str = "burned") -> DataFrame:
    """Per-year threshold from a (year, threshold) table joined on year.

    The threshold table has one row per year; Spark broadcasts it by its bytes."""
    m = annual_max(df, value_col, key, year_col, "_amax")
    j = m.join(thresholds.select(year_col, "threshold"), year_col)
    return j.select(*key, year_col, (F.col("_amax") >= F.col("threshold")).cast("int").alias(out_col))


def prob_rescale(p: Column | str, k: float = RESCALE_K) -> Column:
    """Odds rescale ``p / (p + k (1-p))``; 0 when the denominator is 0."""
    p = F.col(p) if isinstance(p, str) else p
    return F.coalesce(F.try_divide(p, p + F.lit(k) * (1 - p)), F.lit(0.0))


def area_multi_threshold(annual: DataFrame, value_col: str, area_col: str, thresholds,
                         group_cols=("year",)) -> DataFrame:
    """Area with ``annual value >= t`` for each t, long form.

    One aggregate with one conditional sum per threshold, then ``stack`` to long
    form: the pixel table is read once whatever the number of thresholds."""
    aggs = [F.sum(F.when(F.col(value_col) >= F.lit(float(t)), F.col(area_col)).otherwise(0.0)).alias(f"a{i}")
            for i, t in enumerate(thresholds)]
    wide = annual.groupBy(*group_cols).agg(*aggs)
    stack = ", ".join(f"CAST({float(t)!r} AS DOUBLE), a{i}" for i, t in enumerate(thresholds))
    return wide.selectExpr(*group_cols, f"stack({len(thresholds)}, {stack}) AS (threshold, area)")
