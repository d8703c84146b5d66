"""Shared inputs for the registered queries (all derived from the given tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinder.operators.geometry import geographic_pixel_area_m2, pixel_centers
from cinder.operators.geometry import polygon_zone
from cinder.sources.tables import GRID_DX, GRID_DY, GRID_X0, GRID_Y0, pixel_month_obs, zones

AREA_SQL = (f"(CAST({abs(GRID_DX) * 111320.0} AS DOUBLE) * cos(radians(latitude)) "
            f"* CAST({abs(GRID_DY) * 111320.0} AS DOUBLE))")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_month_obs(spark, sf_dir)


def r6(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def pixel_table(spark: SparkSession, sf_dir: str, o: DataFrame | None = None) -> DataFrame:
    """One row per pixel: key, centre, zone (point-in-polygon) and area.

    Centres come from the grid key through the affine transform, so ``o`` can
    be any frame with the pixel key (e.g. the annual mask); Catalyst then
    prunes that branch's scan to the key columns only.  In production this
    dimension is computed once and stored (it does not change with months)."""
    o = o if o is not None else obs(spark, sf_dir)
    keys = o.select("grid_row", "grid_col").distinct()
    pix = pixel_centers(keys, GRID_X0, GRID_DX, GRID_Y0, GRID_DY, x_name="longitude", y_name="latitude")
    # point-in-polygon keeps the point columns, so no join back to ``pix``
    pz = polygon_zone(pix, "longitude", "latitude", zones(spark, sf_dir).select("zone_id", "rings"))
    return (pz
               .withColumn("area_m2", geographic_pixel_area_m2("latitude", GRID_DX, GRID_DY)))
