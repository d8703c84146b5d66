"""Flagship: observed-score annual masks -> burned Mha per zone and year."""

from __future__ import annotations

from cinder.operators.masks import annual_mask
from cinder.operators.zonal import zonal_burned_area
from cinder.plans.common import AREA_SQL, obs, pixel_table
from cinder.plans.registry import query
from cinder.sources.tables import with_obs, zones

MASK_THRESHOLD = 0.5

ZONAL_SQL = with_obs(f"""
SELECT zy.zone_id, zy.ecoregion, zy.year,
       round(coalesce(s.m2, 0.0) * 1e-10, 8) AS burned_mha
FROM zy LEFT JOIN s ON zy.zone_id = s.zone_id AND zy.year = s.year""", f"""
mask AS (SELECT grid_row, grid_col, year, CAST(max(score) >= {MASK_THRESHOLD} AS INTEGER) AS burned
         FROM obs GROUP BY 1, 2, 3),
pix AS (SELECT DISTINCT grid_row, grid_col, zone_id, {AREA_SQL} AS area_m2 FROM obs),
zy AS (SELECT CAST(n_nationkey AS INTEGER) AS zone_id, n_name AS ecoregion, CAST(y AS INTEGER) AS year
       FROM nation, (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM obs)),
s AS (SELECT p.zone_id, m.year, sum(p.area_m2) AS m2
      FROM mask m JOIN pix p ON m.grid_row = p.grid_row AND m.grid_col = p.grid_col
      WHERE m.burned = 1 GROUP BY 1, 2)""")


def zonal_burned_area_df(spark, sf_dir):
    o = obs(spark, sf_dir)
    mask = annual_mask(o, "score", MASK_THRESHOLD)
    # the pixel table is derived from the mask's keys: one read of the inputs
    return zonal_burned_area(mask, pixel_table(spark, sf_dir, mask), zones(spark, sf_dir))


query("zonal_burned_area", ZONAL_SQL)(zonal_burned_area_df)
