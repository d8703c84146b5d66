"""Queries for zonal area, product comparison and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinder.functions.cleaning import prefix_columns
from cinder.functions.hashing import hash_uniform, sql_hash_uniform
from cinder.functions.labels import confusion_label
from cinder.operators.coarse import annual_composite, coarse_grid
from cinder.operators.geometry import cell_mask, geographic_pixel_area_m2, pixel_centers, snap
from cinder.operators.joins import (attach_bands, join_predictions, join_sources, label_to_pixels, merge_store, write_store)
from cinder.operators.masks import annual_mask, annual_mask_dynamic
from cinder.operators.metrics import area_match_threshold
from cinder.operators.zonal import (MHA_PER_M2, area_by_year_total, area_error_report, area_per_cell,
                                   area_products_outer, compare_products, fire_share_by_zone, pixel_zone,
                                   zonal_burned_areas)
from cinder.plans.common import AREA_SQL, obs, pixel_table
from cinder.plans.registry import query
from cinder.plans.sqlgen import annual_composite_ctes, coarse_grid_ctes, rnd, round_doubles
from cinder.session import scratch_path
from cinder.sources.tables import GRID_DX, GRID_DY, GRID_X0, GRID_Y0, read_table, with_obs, zones

K = "grid_row, grid_col, year, month"
KEY = ["grid_row", "grid_col", "year", "month"]
EXCLUDE = ["CANADA", "UNITED STATES"]


def _zonal_cte(name: str, mask_sql: str) -> str:
    """(ecoregion, year, ba_mha) with zones x years zero-filled, as SQL."""
    return f"""
{name}_m AS (SELECT grid_row, grid_col, year, CAST({mask_sql} AS INTEGER) AS burned FROM obs GROUP BY 1, 2, 3),
{name}_s AS (SELECT p.zone_id, m.year, sum(p.area_m2) AS m2 FROM {name}_m m JOIN pix p USING (grid_row, grid_col)
             WHERE m.burned = 1 GROUP BY 1, 2),
{name} AS (SELECT zy.ecoregion, zy.year, coalesce(s.m2, 0.0) * 1e-10 AS ba_mha FROM zy
           LEFT JOIN {name}_s s ON zy.zone_id = s.zone_id AND zy.year = s.year)"""


_BASE_CTES = f"""
pix AS (SELECT DISTINCT grid_row, grid_col, zone_id, {AREA_SQL} AS area_m2 FROM obs),
zy AS (SELECT CAST(n_nationkey AS INTEGER) AS zone_id, n_name AS ecoregion, CAST(y AS INTEGER) AS year
       FROM nation, (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM obs) r),""" + \
    _zonal_cte("pred", "max(score) >= 0.5") + "," + _zonal_cte("obsp", "max(label) >= 1") + """,
alt AS (SELECT n.n_name AS ecoregion, CAST(year(o.o_orderdate) AS INTEGER) AS year,
               count(*) FILTER (WHERE o.o_orderstatus = 'F') * 0.001 AS ba_mha
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        GROUP BY 1, 2)"""


def _own_products(spark, sf):
    """Predicted and observed burned area per (zone, year): one annual aggregate of
    both, one pixel table from its keys, one zonal sum."""
    annual = obs(spark, sf).groupBy("grid_row", "grid_col", "year").agg(
        (F.max("score") >= 0.5).cast("int").alias("pred_mask"), F.max("label").alias("obs_mask"))
    both = zonal_burned_areas(annual, pixel_table(spark, sf, annual), zones(spark, sf),
                              {"pred_mha": "pred_mask", "obs_mha": "obs_mask"})
    return both.drop("zone_id")


def _alt_product(spark, sf):
    """The second product, keyed like the first."""
    orders = read_table(spark, sf, "orders")
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("ecoregion"))
    return (orders.join(cust, orders.o_custkey == cust.c_custkey)
                  .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                  .groupBy("ecoregion", F.year("o_orderdate").alias("year"))
                  .agg((F.count(F.when(F.col("o_orderstatus") == "F", 1)) * 0.001).alias("ba_mha")))


@query("compare_products", with_obs(f"""
SELECT p.ecoregion, p.year, {rnd('p.ba_mha', 8)} AS ba_pred_Mha, {rnd('o.ba_mha', 8)} AS ba_obs_Mha,
       {rnd('a.ba_mha', 8)} AS ba_alt_Mha
FROM pred p LEFT JOIN obsp o ON p.ecoregion = o.ecoregion AND p.year = o.year
LEFT JOIN alt a ON p.ecoregion = a.ecoregion AND p.year = a.year""", _BASE_CTES))
def q_compare_products(spark, sf):
    """One column per product left-merged on (zone, year)."""
    base = _own_products(spark, sf).withColumnsRenamed({"pred_mha": "ba_pred_Mha", "obs_mha": "ba_obs_Mha"})
    return round_doubles(compare_products(base, {"alt": _alt_product(spark, sf)}), 8)


@query("area_products_outer", with_obs(f"""
SELECT ecoregion, year, {rnd('coalesce(sum(CASE WHEN pr = 1 THEN v END), 0.0)', 8)} AS ba_pred_Mha,
       {rnd('coalesce(sum(CASE WHEN pr = 2 THEN v END), 0.0)', 8)} AS ba_obs_Mha,
       {rnd('coalesce(sum(CASE WHEN pr = 3 THEN v END), 0.0)', 8)} AS ba_alt_Mha
FROM (SELECT ecoregion, year, 1 AS pr, ba_mha AS v FROM pred UNION ALL SELECT ecoregion, year, 2, ba_mha FROM obsp
      UNION ALL SELECT ecoregion, year, 3, ba_mha FROM alt) u GROUP BY 1, 2""", _BASE_CTES))
def q_area_products_outer(spark, sf):
    """Full outer merge of products keyed (zone, year), 0-filled."""
    own = _own_products(spark, sf).withColumnsRenamed({"pred_mha": "ba_pred_Mha", "obs_mha": "ba_obs_Mha"})
    alt = _alt_product(spark, sf).withColumnRenamed("ba_mha", "ba_alt_Mha")
    return round_doubles(area_products_outer([own, alt]), 8)


@query("area_by_year_total", with_obs(
    f"SELECT year, {rnd('sum(ba_mha)', 8)} AS total_mha FROM pred WHERE ecoregion NOT IN "
    f"({', '.join(repr(e) for e in EXCLUDE)}) GROUP BY year", _BASE_CTES))
def q_area_by_year_total(spark, sf):
    """Annual totals across zones without the excluded zones."""
    return round_doubles(area_by_year_total(_own_products(spark, sf), "pred_mha", EXCLUDE), 8)


@query("area_error_report", with_obs(f"""
SELECT ecoregion, {rnd('sum(coalesce(pv, 0.0))', 8)} AS pred_mha, {rnd('sum(coalesce(rv, 0.0))', 8)} AS ref_mha,
       {rnd('sum(coalesce(pv, 0.0)) - sum(coalesce(rv, 0.0))', 8)} AS diff_mha,
       {rnd('(sum(coalesce(pv, 0.0)) - sum(coalesce(rv, 0.0))) / nullif(sum(coalesce(rv, 0.0)), 0) * 100', 8)} AS pct_error
FROM (SELECT coalesce(p.ecoregion, o.ecoregion) AS ecoregion, p.ba_mha AS pv, o.ba_mha AS rv
      FROM (SELECT * FROM pred WHERE year IN (1999, 2000)) p
      FULL JOIN (SELECT * FROM obsp WHERE year IN (1999, 2000)) o ON p.ecoregion = o.ecoregion AND p.year = o.year) t
GROUP BY ROLLUP (ecoregion)""", _BASE_CTES))
def q_area_error_report(spark, sf):
    """Predicted vs reference area for the test years, per zone plus a
    grand-total row, with difference and % error."""
    test = _own_products(spark, sf).where(F.col("year").isin([1999, 2000]))
    return round_doubles(area_error_report(test, "pred_mha", "obs_mha"), 8)


@query("fire_share_by_zone", with_obs(f"""
SELECT n_name AS ecoregion, CAST(sum(label) AS BIGINT) AS n_fire,
       {rnd('sum(label) * 100.0 / (SELECT sum(label) FROM obs)')} AS pct_of_total
FROM obs JOIN nation ON obs.zone_id = nation.n_nationkey GROUP BY n_name"""))
def q_fire_share_by_zone(spark, sf):
    """Fire pixel-months per zone and share of the total."""
    o = obs(spark, sf)
    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("ecoregion"))
    return round_doubles(fire_share_by_zone(o.join(n, "zone_id")))


@query("area_per_cell", with_obs(f"""
SELECT year, {rnd('floor(longitude)')} AS big_lon, {rnd('floor(latitude)')} AS big_lat,
       {rnd('sum(CASE WHEN burned = 1 THEN area_m2 ELSE 0.0 END) * 1e-4')} AS burned_ha
FROM (SELECT grid_row, grid_col, year, any_value(longitude) AS longitude, any_value(latitude) AS latitude,
             any_value({AREA_SQL}) AS area_m2, CAST(max(score) >= 0.5 AS INTEGER) AS burned FROM obs GROUP BY 1, 2, 3) t
GROUP BY 1, 2, 3"""))
def q_area_per_cell(spark, sf):
    """Burned hectares per 1 degree cell and year, 0 where none."""
    o = obs(spark, sf)
    # Centre and area follow from the grid key, so pixels outside every zone count too.
    m = pixel_centers(annual_mask(o, "score", 0.5), GRID_X0, GRID_DX, GRID_Y0, GRID_DY, x_name="longitude", y_name="latitude")
    m = m.withColumn("area_m2", geographic_pixel_area_m2("latitude", GRID_DX, GRID_DY))
    m = m.withColumns({"big_lon": snap("longitude", 1.0), "big_lat": snap("latitude", 1.0)})
    return round_doubles(area_per_cell(m, ["year", "big_lon", "big_lat"], "burned", "area_m2"))


@query("clip_area_by_year", with_obs(f"""
SELECT year, {rnd('sum(area_m2) * 1e-10', 8)} AS burned_mha, count(*) AS n_pixels FROM (
  SELECT grid_row, grid_col, year, any_value({AREA_SQL}) AS area_m2 FROM obs
  WHERE zone_id IN (SELECT n_nationkey FROM nation) GROUP BY 1, 2, 3 HAVING max(label) > 0) t GROUP BY year"""))
def q_clip_area_by_year(spark, sf):
    """Clip the annual burn mask to the zone polygons and sum area."""
    o = obs(spark, sf)
    pix = pixel_table(spark, sf, o)                      # inside some polygon only
    m = annual_mask(o, "label", 1.0).where("burned = 1").join(pix, ["grid_row", "grid_col"], "inner")
    return m.groupBy("year").agg(F.round(F.round(F.sum("area_m2") * MHA_PER_M2, 10), 8).alias("burned_mha"),
                                 F.count(F.lit(1)).alias("n_pixels"))


@query("polygon_zone", with_obs("SELECT DISTINCT grid_row, grid_col, zone_id FROM obs"))
def q_polygon_zone(spark, sf):
    """Point-in-polygon zone of every pixel centre (bucketed join +
    ray cast); the fixture zones are rectangles so the oracle uses the formula."""
    o = obs(spark, sf)
    return pixel_zone(o, zones(spark, sf))


_CG = annual_composite_ctes() + ",\n" + coarse_grid_ctes()


@query("join_predictions", with_obs(f"""
SELECT cg.year, cg.ID, cg.burned_label, {rnd('pr.pred_prob')} AS pred_prob, pr.pred_label,
       CASE WHEN cg.burned_label IS NULL OR pr.pred_label IS NULL THEN 'NA'
            WHEN pr.pred_label = 1 AND cg.burned_label = 1 THEN 'TP' WHEN pr.pred_label = 0 AND cg.burned_label = 1 THEN 'FN'
            WHEN pr.pred_label = 0 AND cg.burned_label = 0 THEN 'TN' ELSE 'FP' END AS pred_obs
FROM cg LEFT JOIN (SELECT year, ID, {sql_hash_uniform('cellpred', 'year', 'ID')} AS pred_prob,
                          CAST({sql_hash_uniform('cellpred', 'year', 'ID')} >= 0.5 AS INTEGER) AS pred_label
                   FROM cg WHERE ID % 7 <> 3) pr ON cg.year = pr.year AND cg.ID = pr.ID""", _CG))
def q_join_predictions(spark, sf):
    """Validated one-to-one left join of cell predictions by ID."""
    cells = coarse_grid(annual_composite(obs(spark, sf)), 1.0)
    preds = (cells.where(F.col("ID") % 7 != 3)
                  .select("year", "ID", hash_uniform("cellpred", "year", "ID").alias("pred_prob"))
                  .withColumn("pred_label", (F.col("pred_prob") >= 0.5).cast("int")))
    j = join_predictions(cells.select("year", "ID", "burned_label"), preds, ["year", "ID"])
    j = j.withColumn("pred_obs", confusion_label("burned_label", "pred_label"))
    return round_doubles(j.select("year", "ID", "burned_label", "pred_prob", "pred_label", "pred_obs"))


@query("label_to_pixels", with_obs(f"""
SELECT ac.grid_row, ac.grid_col, ac.year, cg.burned_label FROM ac LEFT JOIN cg
  ON ac.year = cg.year AND CAST(1.0 AS DOUBLE) * floor(ac.longitude / CAST(1.0 AS DOUBLE)) = cg.big_lon
 AND CAST(1.0 AS DOUBLE) * floor(ac.latitude / CAST(1.0 AS DOUBLE)) = cg.big_lat""", _CG))
def q_label_to_pixels(spark, sf):
    """Coarse cell label attached back to each pixel-year."""
    ac = annual_composite(obs(spark, sf))
    cells = coarse_grid(ac, 1.0)
    return label_to_pixels(ac.select("grid_row", "grid_col", "year", "longitude", "latitude"), cells, 1.0) \
        .select("grid_row", "grid_col", "year", "burned_label")


@query("burnable_mask", with_obs(f"""
SELECT {K} FROM obs o WHERE EXISTS (SELECT 1 FROM cg WHERE cg.burned_label = 1 AND cg.year = o.year
  AND cg.big_lon = CAST(1.0 AS DOUBLE) * floor(o.longitude / CAST(1.0 AS DOUBLE))
  AND cg.big_lat = CAST(1.0 AS DOUBLE) * floor(o.latitude / CAST(1.0 AS DOUBLE)))""", _CG))
def q_burnable_mask(spark, sf):
    """Pixel-months inside burnable coarse cells (semi join)."""
    o = obs(spark, sf)
    cells = coarse_grid(annual_composite(o), 1.0)
    return cell_mask(o, cells, 1.0, "burned_label").select(*KEY)


@query("attach_index_bands", with_obs(
    f"SELECT {K}, {rnd('a.DEM')} AS DEM, {rnd('b.fire_weather_index')} AS fire_weather_index "
    "FROM obs a JOIN (SELECT grid_row, grid_col, year, month, fire_weather_index FROM obs WHERE month <> 3) b "
    "USING (grid_row, grid_col, year, month)"))
def q_attach_index_bands(spark, sf):
    """Attach the index stack to the predictor stack by pixel-month; a
    month missing from either side drops out (inner join)."""
    o = obs(spark, sf)
    preds = o.select(*KEY, "DEM")
    fwi = o.where("month <> 3").select(*KEY, "fire_weather_index")
    return round_doubles(attach_bands(preds, fwi, KEY))


_SRC_SQL = """
src AS (
  SELECT longitude AS x, latitude AS y, year, month, 'ERA5' AS ds, temperature_2m AS v FROM obs WHERE grid_col % 2 = 0
  UNION ALL SELECT longitude, latitude, year, month, 'CEMS', fire_weather_index FROM obs WHERE grid_row % 3 <> 0
  UNION ALL SELECT longitude, latitude, year, month, 'LC', b1 FROM obs WHERE month <= 6)"""


@query("join_predictors", with_obs(f"""
SELECT {rnd('x')} AS x, {rnd('y')} AS y, year, month,
       {rnd("max(CASE WHEN ds = 'ERA5' THEN v END)")} AS ERA5__temperature_2m,
       {rnd("max(CASE WHEN ds = 'CEMS' THEN v END)")} AS CEMS__fire_weather_index,
       {rnd("max(CASE WHEN ds = 'LC' THEN v END)")} AS LC__b1
FROM src WHERE month IS NOT NULL AND month >= 1 GROUP BY x, y, year, month""", _SRC_SQL))
def q_join_predictors(spark, sf):
    """N-way full outer join of per-source tables on (x, y, year,
    month), prefixed columns; months < 1 / NULL dropped; a source without a
    month column is skipped."""
    o = obs(spark, sf).withColumnsRenamed({"longitude": "x", "latitude": "y"})
    keys = ["x", "y", "year", "month"]
    era5 = prefix_columns(o.where(F.col("grid_col") % 2 == 0).select(*keys, "temperature_2m"), "ERA5", keys)
    cems = prefix_columns(o.where(F.col("grid_row") % 3 != 0).select(*keys, "fire_weather_index"), "CEMS", keys)
    lc = prefix_columns(o.where("month <= 6").select(*keys, "b1"), "LC", keys)
    static = o.select("x", "y", "year", "DEM")          # no month: skipped
    out = join_sources([era5, cems, lc, static], keys)
    return round_doubles(out)


# Thirteen sources: (name, columns, rows that it has).  A source's columns carry its name.
SOURCES = [
    ("TERRAIN", ["DEM", "slope", "aspect"], "grid_row % 7 <> 3"), ("COVER", ["b1"], "month <= 6"), ("HUMIDITY", ["relative_humidity"], "grid_col % 2 = 0"),
    ("RAIN", ["total_precipitation_sum"], "grid_col % 3 <> 1"), ("MEAN_T", ["temperature_2m"], "grid_col % 2 = 1"), ("LEAST_T", ["temperature_2m_min"], "month > 2"),
    ("MOST_T", ["temperature_2m_max"], "month < 12"), ("BUI", ["build_up_index"], "grid_row % 3 <> 0"), ("DC", ["drought_code"], "grid_row % 4 <> 0"),
    ("DMC", ["duff_moisture_code"], "grid_row % 5 <> 0"), ("FFMC", ["fine_fuel_moisture_code"], "year > 1993"), ("FWI", ["fire_weather_index"], "grid_col % 5 <> 2"),
    ("ISI", ["initial_fire_spread_index"], "year < 1998")]
STORE_BUCKETS = 8


@query("predictor_store", with_obs(
    f"SELECT {K}, " + ", ".join(f"{rnd(f'CASE WHEN {rows} THEN {c} END')} AS {n}__{c}" for n, cols, rows in SOURCES for c in cols)
    + " FROM obs WHERE " + " OR ".join(f"({rows})" for _, _, rows in SOURCES)))
def q_predictor_store(spark, sf):
    """The full outer join of all 13 predictor sources from a store bucketed by the
    pixel-month key: the merge plans no shuffle."""
    o = obs(spark, sf)
    sources = {n: prefix_columns(o.where(rows).select(*KEY, *cols), n, KEY) for n, cols, rows in SOURCES}
    path = scratch_path(spark, "store")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    write_store(sources, table, path, KEY, STORE_BUCKETS)
    return round_doubles(merge_store(spark.table(table), KEY))


@query("annual_mask_dynamic", with_obs(f"""
SELECT a.grid_row, a.grid_col, a.year, CAST(a.amax >= q.threshold AS INTEGER) AS burned
FROM (SELECT grid_row, grid_col, year, max(p) AS amax FROM s GROUP BY 1, 2, 3) a
JOIN (SELECT year, CASE WHEN nb = 0 THEN 0.99 ELSE quantile END AS threshold FROM q) q ON a.year = q.year""",
    """s AS (SELECT grid_row, grid_col, year, month, label, label * CAST(0.35 AS DOUBLE) + u_score * CAST(0.65 AS DOUBLE) AS p FROM obs),
r AS (SELECT year, p, row_number() OVER (PARTITION BY year ORDER BY p) - 1 AS idx FROM s),
t AS (SELECT year, count(*) AS n, sum(label) AS nb FROM s GROUP BY year),
tp AS (SELECT *, (n - 1) * (1 - nb / n) AS pos FROM t),
q AS (SELECT tp.year, tp.nb, lo.p + (tp.pos - floor(tp.pos)) * (hi.p - lo.p) AS quantile
      FROM tp JOIN r lo ON lo.year = tp.year AND lo.idx = floor(tp.pos) JOIN r hi ON hi.year = tp.year AND hi.idx = ceil(tp.pos))"""))
def q_annual_mask_dynamic(spark, sf):
    """Per-year threshold (area match) looked up by year, then ``p >= t``."""
    s = obs(spark, sf).withColumn("p", F.col("label") * 0.35 + F.col("u_score") * 0.65)
    thr = area_match_threshold(s, "label", "p", ["year"])
    return annual_mask_dynamic(s, "p", thr)
