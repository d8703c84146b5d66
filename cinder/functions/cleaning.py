"""Cleaning and filtering expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinder.functions.labels import ternary_label
from cinder.schema import CATEGORICAL, FEATURES, FWI_NONNEG, PHYS_RULES


def coerce_numeric(c) -> Column:
    """C11: bad values -> NULL (``try_cast``), like ``to_numeric(errors='coerce')``."""
    x = F.col(c) if isinstance(c, str) else c
    return x.cast("string").try_cast("double")


def finite_or_null(c) -> Column:
    """C12 part: NaN and +-inf -> NULL."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def drop_invalid(df: DataFrame, cols) -> DataFrame:
    """+-inf/NaN -> NULL, then drop rows with any NULL in ``cols``."""
    return df.withColumns({c: finite_or_null(c) for c in cols}).na.drop(subset=list(cols))


def clean_training(df: DataFrame, features=FEATURES, fraction_col: str = "fraction",
                   label_col: str = "burned_pixel") -> DataFrame:
    """Coerce numerics, strict ternary label (rows at 0.5 dropped),
    non-negative FWI codes, ``b1`` rounded half-even to int, drop incomplete rows."""
    d = df.withColumns({c: finite_or_null(coerce_numeric(c)) for c in [*features, fraction_col]})
    d = d.withColumn(label_col, ternary_label(fraction_col))
    for c in FWI_NONNEG:
        if c in features:
            d = d.where(F.col(c) >= 0)
    for c in CATEGORICAL:
        if c in features:
            d = d.withColumn(c, F.rint(F.col(c)).cast("int"))
    return d.na.drop(subset=[*features, label_col])


def phys_filter(df: DataFrame, rules=PHYS_RULES) -> DataFrame:
    """Drop rows breaking any physical rule; a NULL comparison never drops
    (as in pandas, where NaN compares false)."""
    drops = []
    for c, (op, v) in rules.items():
        if c in df.columns:
            cmp = F.col(c) > v if op == ">" else F.col(c) < v
            drops.append(F.coalesce(cmp, F.lit(False)))
    if not drops:
        return df
    return df.where(~reduce(lambda a, b: a | b, drops))


def sentinel_filter(df: DataFrame, limit: float = -1000.0) -> DataFrame:
    """C17: drop a row if any numeric column is below ``limit``."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    bad = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < limit, F.lit(False)) for c in num])
    return df.where(~bad)


def domain_filter(df: DataFrame, dem_col: str = "DEM", min_dem: float = -500.0,
                  required: str = "build_up_index") -> DataFrame:
    """Land pixels: DEM > -500 and a valid required band."""
    return df.where((F.col(dem_col) > min_dem) & F.col(required).isNotNull())


def null_mask_by(c, by) -> Column:
    """Value only where ``by`` is not NULL."""
    return F.when(F.col(by).isNotNull(), F.col(c) if isinstance(c, str) else c)


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add missing columns as typed NULLs, drop extras, order and type
    columns as in ``schema``."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def prefix_columns(df: DataFrame, dataset: str, keys) -> DataFrame:
    """``<DATASET>__col`` for every non-key column."""
    return df.select(*keys, *[F.col(c).alias(f"{dataset}__{c}") for c in df.columns if c not in keys])
