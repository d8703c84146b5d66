"""Zonal burned area and product comparison.

Pixels are assigned to zones once (``pixel_zone``); every later step is an
equi-join on the pixel key and a grouped sum.  Zones with no burned pixel get
0.0 by starting from the zone x year frame, which is built with ``explode`` of
the year range (a generator, not a join) so no cross product is planned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinder.operators.geometry import polygon_zone
from cinder.schema import PIXEL_KEY

HA_PER_M2 = 1e-4
MHA_PER_M2 = 1e-10


def pixel_zone(pixels: DataFrame, zones: DataFrame, key=PIXEL_KEY, lon_col: str = "longitude",
               lat_col: str = "latitude") -> DataFrame:
    """One row per distinct pixel inside a zone: ``key + zone_id``."""
    pts = pixels.select(*key, lon_col, lat_col).dropDuplicates(list(key))
    return polygon_zone(pts, lon_col, lat_col, zones.select("zone_id", "rings")).select(*key, "zone_id")


def zone_years(zones: DataFrame, facts: DataFrame, year_col: str = "year") -> DataFrame:
    """Every zone for every year from the first to the last year in ``facts``."""
    years = facts.select(F.sequence(F.min(year_col), F.max(year_col))).scalar()   # one scalar subquery
    return zones.select("zone_id", "ecoregion", F.explode(years).alias(year_col))


def zonal_burned_area(mask: DataFrame, pixels: DataFrame, zones: DataFrame,
                      key=PIXEL_KEY, flag_col: str = "burned", area_col: str = "area_m2",
                      out_col: str = "burned_mha") -> DataFrame:
    """Burned Mha per zone and year; 0.0 for zones without burn.

    ``mask``: key + year + flag; ``pixels``: key + zone_id + area (one row per
    pixel, e.g. from :func:`pixel_zone` joined to a pixel-area column)."""
    return zonal_burned_areas(mask, pixels, zones, {out_col: flag_col}, key, area_col)


def zonal_burned_areas(mask: DataFrame, pixels: DataFrame, zones: DataFrame, flags: dict[str, str],
                       key=PIXEL_KEY, area_col: str = "area_m2") -> DataFrame:
    """G11 for several masks of one pixel-year table: ``flags`` maps an output column
    to its flag column.  One join to the pixels and one grouped sum serve all."""
    any_flag = reduce(lambda a, b: a | b, [F.col(f) == 1 for f in flags.values()])
    burned = (mask.where(any_flag).select(*key, "year", *dict.fromkeys(flags.values()))
                  .join(pixels.select(*key, "zone_id", area_col), list(key)))
    sums = burned.groupBy("zone_id", "year").agg(
        *[F.sum(F.when(F.col(f) == 1, F.col(area_col))).alias(f"_m2_{out}") for out, f in flags.items()])
    out = zone_years(zones, mask).join(sums, ["zone_id", "year"], "left")
    return out.select("zone_id", "ecoregion", "year", *[
        F.round(F.coalesce(F.col(f"_m2_{c}"), F.lit(0.0)) * MHA_PER_M2, 8).alias(c) for c in flags])


def area_products_outer(products: list[DataFrame], keys=("ecoregion", "year")) -> DataFrame:
    """Full outer merge of product tables keyed (zone, year), 0-filled; every
    other column is one product's area.

    Expressed as a union + one grouped aggregate (one shuffle) instead of a
    chain of full outer joins (one shuffle per product)."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), products)
    return u.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in u.columns if c not in keys])


def compare_products(base: DataFrame, others: dict[str, DataFrame], keys=("ecoregion", "year"),
                     value_col: str = "ba_mha") -> DataFrame:
    """Left-merge one column per model onto the base (zone, year) table."""
    out = base
    for n, df in others.items():
        out = out.join(df.select(*keys, F.col(value_col).alias(f"ba_{n}_Mha")), list(keys), "left")
    return out


def area_by_year_total(zonal: DataFrame, value_col: str, exclude=None) -> DataFrame:
    """Annual totals across zones, optionally excluding zones."""
    df = zonal
    if exclude:
        df = df.where(~F.col("ecoregion").isin(list(exclude)))
    return df.groupBy("year").agg(F.round(F.sum(value_col), 8).alias("total_mha"))


def area_error_report(areas: DataFrame, pred_col: str, ref_col: str, keys=("ecoregion",)) -> DataFrame:
    """Per-zone and grand-total predicted vs reference area, diff and % error,
    of one table with both areas (e.g. from :func:`area_products_outer`).

    ``rollup`` yields the grand-total row (zone NULL) in the same aggregate."""
    g = areas.rollup(*keys).agg(F.sum(F.coalesce(pred_col, F.lit(0.0))).alias("pred_mha"),
                                F.sum(F.coalesce(ref_col, F.lit(0.0))).alias("ref_mha"))
    return g.select(*keys, "pred_mha", "ref_mha", (F.col("pred_mha") - F.col("ref_mha")).alias("diff_mha"),
                    (F.try_divide(F.col("pred_mha") - F.col("ref_mha"), F.col("ref_mha")) * 100).alias("pct_error"))


def fire_share_by_zone(labelled: DataFrame, zone_col: str = "ecoregion",
                       label_col: str = "label") -> DataFrame:
    """Fire pixels per zone and percent of all fire pixels."""
    g = labelled.groupBy(zone_col).agg(F.sum(label_col).cast("bigint").alias("n_fire"))
    total = labelled.select(F.sum(label_col)).scalar()   # scalar subquery, no window
    return g.select(zone_col, "n_fire", F.round(F.try_divide(F.col("n_fire") * 100.0, total), 6)
                    .alias("pct_of_total"))


def area_per_cell(pixels: DataFrame, cell_cols, flag_col: str, area_col: str) -> DataFrame:
    """Burned hectares per coarse cell, 0 for cells without burn."""
    return pixels.groupBy(*cell_cols).agg(
        F.round(F.sum(F.when(F.col(flag_col) == 1, F.col(area_col)).otherwise(0.0)) * HA_PER_M2, 6)
        .alias("burned_ha"))
