"""Queries for grid geometry and resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cinder.operators.coarse import annual_composite
from cinder.operators.diagnostics import climatology
from cinder.operators.geometry import (WGS84_A, WGS84_F, bilinear_resample, burn_fraction_monthly,
                                       coord_to_cell, geographic_pixel_area_m2, grid_guard,
                                       lonlat_from_xy, nearest_resample, overlap_resample, pixel_centers, project_lonlat)
from cinder.operators.masks import annual_mask
from cinder.plans.common import AREA_SQL, obs
from cinder.plans.registry import query
from cinder.plans.sqlgen import rnd, round_doubles
from cinder.schema import FEATURES, PIXEL_AREA_HA_4KM
from cinder.sources.tables import (GRID_COLS, GRID_DX, GRID_DY, GRID_ROWS, GRID_X0, GRID_Y0, read_table,
                                   with_obs)

KEY = ["grid_row", "grid_col", "year", "month"]
FACTOR = 4                                   # fine cells per coarse cell side
FINE_DX, FINE_DY = GRID_DX / FACTOR, GRID_DY / FACTOR
COARSE = {"x0": GRID_X0, "dx": GRID_DX, "y0": GRID_Y0, "dy": GRID_DY, "width": GRID_COLS, "height": GRID_ROWS}


BANDS = ["fraction", *FEATURES]


@query("bands_to_columns", with_obs(
    f"SELECT {', '.join(KEY)}, " + ", ".join(f"{rnd(f'max(CASE WHEN band = {b!r} THEN value END)')} AS {b}" for b in BANDS)
    + f" FROM (UNPIVOT (SELECT {', '.join([*KEY, *BANDS])} FROM obs) ON {', '.join(BANDS)} INTO NAME band VALUE value) u GROUP BY 1, 2, 3, 4"))
def q_bands_to_columns(spark, sf):
    """B1: long (pixel, band, value) of every band -> one column per band (pivot with the
    band list given, so no extra pass to discover values)."""
    long = obs(spark, sf).unpivot(KEY, BANDS, "band", "value")
    wide = long.groupBy(*KEY).pivot("band", BANDS).agg(F.max("value"))
    return round_doubles(wide)


@query("pixel_centers", with_obs(
    f"SELECT DISTINCT grid_row, grid_col, {rnd(f'{GRID_X0} + (grid_col + 0.5) * {GRID_DX}')} AS x, "
    f"{rnd(f'{GRID_Y0} + (grid_row + 0.5) * ({GRID_DY})')} AS y FROM obs"))
def q_pixel_centers(spark, sf):
    """B2: pixel-centre coordinates from the affine transform."""
    p = obs(spark, sf).select("grid_row", "grid_col").distinct()
    return round_doubles(pixel_centers(p, GRID_X0, GRID_DX, GRID_Y0, GRID_DY))


_PTS_SQL = ("SELECT l_orderkey, l_linenumber, -151.0 + (l_extendedprice % 1200) / 100.0 AS px, "
            "66.0 - ((l_quantity * 13) % 700) / 100.0 AS py FROM lineitem")


def _points(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     (F.lit(-151.0) + (F.col("l_extendedprice") % 1200) / 100.0).alias("px"),
                     (F.lit(66.0) - ((F.col("l_quantity") * 13) % 700) / 100.0).alias("py"))


@query("coord_to_cell", f"""
SELECT l_orderkey, l_linenumber, CAST(floor((py - {GRID_Y0}) / ({GRID_DY})) AS INTEGER) AS cell_row,
       CAST(floor((px - ({GRID_X0})) / {GRID_DX}) AS INTEGER) AS cell_col
FROM ({_PTS_SQL}) p
WHERE floor((py - {GRID_Y0}) / ({GRID_DY})) BETWEEN 0 AND {GRID_ROWS - 1}
  AND floor((px - ({GRID_X0})) / {GRID_DX}) BETWEEN 0 AND {GRID_COLS - 1}""")
def q_coord_to_cell(spark, sf):
    """Inverse transform (floor rule) dropping points outside the grid."""
    c = coord_to_cell(_points(spark, sf), "px", "py", GRID_X0, GRID_DX, GRID_Y0, GRID_DY, GRID_COLS, GRID_ROWS)
    return c.select("l_orderkey", "l_linenumber", "cell_row", "cell_col")


def _stereo_sql(lon: str, lat: str) -> tuple[str, str]:
    a, f = WGS84_A, WGS84_F
    e = math.sqrt(2 * f - f * f)
    phic = math.radians(70.0)
    mc = math.cos(phic) / math.sqrt(1 - e * e * math.sin(phic) ** 2)
    tc = math.tan(math.pi / 4 - phic / 2) / ((1 - e * math.sin(phic)) / (1 + e * math.sin(phic))) ** (e / 2)
    phi = f"radians({lat})"
    t = (f"(tan({math.pi / 4!r} - {phi} / 2) / pow((1 - {e!r} * sin({phi})) / (1 + {e!r} * sin({phi})), {e / 2!r}))")
    lam = f"(radians({lon}) - {math.radians(-45.0)!r})"
    rho = f"({a * mc / tc!r} * {t})"
    return f"{rho} * sin({lam})", f"-{rho} * cos({lam})"


def _laea_sql(lon: str, lat: str) -> tuple[str, str]:
    e = math.sqrt(2 * WGS84_F - WGS84_F**2)

    def q(sin: str) -> str:
        return (f"((1 - {e * e!r}) * ({sin} / (1 - {e * e!r} * {sin} * {sin}) "
                f"- ln((1 - {e!r} * {sin}) / (1 + {e!r} * {sin})) / {2 * e!r}))")

    rho = f"({WGS84_A!r} * sqrt(greatest({q('1.0')} - {q(f'sin(radians({lat}))')}, 0.0)))"
    return f"{rho} * sin(radians({lon}))", f"-{rho} * cos(radians({lon}))"


_SX, _SY = _stereo_sql("longitude", "latitude")
_LX, _LY = _laea_sql("longitude", "latitude")


@query("project_lonlat", with_obs(
    f"SELECT grid_row, grid_col, {rnd(_SX, 2)} AS proj_x, {rnd(_SY, 2)} AS proj_y, {rnd(_LX, 2)} AS laea_x, "
    f"{rnd(_LY, 2)} AS laea_y FROM (SELECT DISTINCT grid_row, grid_col, longitude, latitude FROM obs) p"))
def q_project_lonlat(spark, sf):
    """lon/lat -> EPSG:3413 polar stereographic and EPSG:6931 equal-area."""
    p = obs(spark, sf).select("grid_row", "grid_col", "longitude", "latitude").distinct()
    a = project_lonlat(p, "longitude", "latitude", "EPSG:3413")
    b = project_lonlat(p, "longitude", "latitude", "EPSG:6931").withColumnsRenamed({"proj_x": "laea_x",
                                                                                    "proj_y": "laea_y"})
    out = a.join(b.select("grid_row", "grid_col", "laea_x", "laea_y"), ["grid_row", "grid_col"])
    return round_doubles(out.select("grid_row", "grid_col", "proj_x", "proj_y", "laea_x", "laea_y"), 2)


@query("lonlat_from_xy", with_obs(
    f"SELECT DISTINCT grid_row, grid_col, {rnd('longitude')} AS lon, {rnd('latitude')} AS lat, "
    f"{rnd('longitude')} AS laea_lon, {rnd('latitude')} AS laea_lat FROM obs"))
def q_lonlat_from_xy(spark, sf):
    """B4 inverse: EPSG:3413 and EPSG:6931 -> lon/lat; a round trip ends where it began."""
    p = obs(spark, sf).select("grid_row", "grid_col", "longitude", "latitude").distinct()
    a = lonlat_from_xy(project_lonlat(p, "longitude", "latitude", "EPSG:3413"), "proj_x", "proj_y", "EPSG:3413")
    b = project_lonlat(a.drop("proj_x", "proj_y").withColumnsRenamed({"lon": "first_lon", "lat": "first_lat"}),
                       "longitude", "latitude", "EPSG:6931")
    b = lonlat_from_xy(b, "proj_x", "proj_y", "EPSG:6931")
    return round_doubles(b.select("grid_row", "grid_col", F.col("first_lon").alias("lon"), F.col("first_lat").alias("lat"),
                                  F.col("lon").alias("laea_lon"), F.col("lat").alias("laea_lat")))


# --- fine annual burn-date grid derived from lineitem (4x finer than obs) ---
_FINE_SQL = f"""
fine AS (SELECT CAST((l_partkey * 7 + l_suppkey) % {GRID_ROWS * FACTOR} AS INTEGER) AS fine_row,
                CAST(l_partkey % {GRID_COLS * FACTOR} AS INTEGER) AS fine_col,
                CAST(year(l_shipdate) AS INTEGER) AS year,
                max(CASE WHEN l_tax = 0 THEN NULL WHEN l_discount > 0.05 THEN dayofyear(l_shipdate) ELSE 0 END) AS doy
         FROM lineitem GROUP BY 1, 2, 3)"""


def _fine(spark, sf):
    li = read_table(spark, sf, "lineitem")
    doy = F.when(F.col("l_tax") == 0, F.lit(None)).when(F.col("l_discount") > 0.05, F.dayofyear("l_shipdate")) \
        .otherwise(F.lit(0))
    return li.groupBy(((F.col("l_partkey") * 7 + F.col("l_suppkey")) % (GRID_ROWS * FACTOR)).cast("int").alias("fine_row"),
                      (F.col("l_partkey") % (GRID_COLS * FACTOR)).cast("int").alias("fine_col"),
                      F.year("l_shipdate").alias("year")).agg(F.max(doy).alias("doy"))


def _bf_sql(nodata_as_zero: bool) -> str:
    denom = "n_all" if nodata_as_zero else "(n_all - n_nodata)"
    return with_obs(f"""
SELECT c.grid_row, c.grid_col, c.year, CAST(m.month AS INTEGER) AS month,
       {rnd(f'coalesce(b.n_burned, 0) / nullif({denom}, 0)')} AS burn_fraction
FROM (SELECT CAST(floor(fine_row / {FACTOR}) AS INTEGER) AS grid_row, CAST(floor(fine_col / {FACTOR}) AS INTEGER) AS grid_col,
             year, count(*) AS n_all, sum(CAST(doy IS NULL AS INTEGER)) AS n_nodata FROM fine GROUP BY 1, 2, 3) c
CROSS JOIN range(1, 13) m(month)
LEFT JOIN (SELECT CAST(floor(fine_row / {FACTOR}) AS INTEGER) AS grid_row, CAST(floor(fine_col / {FACTOR}) AS INTEGER) AS grid_col,
                  year, month(make_date(year, 1, 1) + CAST(doy - 1 AS INTEGER)) AS month, count(*) AS n_burned
           FROM fine WHERE doy > 0 GROUP BY 1, 2, 3, 4) b
  ON b.grid_row = c.grid_row AND b.grid_col = c.grid_col AND b.year = c.year AND b.month = m.month""", _FINE_SQL)


@query("burn_fraction_monthly", _bf_sql(True))
def q_burn_fraction_monthly(spark, sf):
    """Monthly burned fraction of each coarse cell from a fine annual
    burn-date grid (nodata counted as unburned)."""
    return round_doubles(burn_fraction_monthly(_fine(spark, sf), FACTOR, nodata_as_zero=True))


@query("burn_fraction_nodata", _bf_sql(False))
def q_burn_fraction_nodata(spark, sf):
    """Same with nodata cells ignored."""
    return round_doubles(burn_fraction_monthly(_fine(spark, sf), FACTOR, nodata_as_zero=False))


# A coarse grid whose cells the fine ones do not nest in: other size, other origin.
OTHER = {"x0": -150.13, "dx": 0.41, "y0": 65.09, "dy": -0.37, "width": 25, "height": 15}


@query("burn_fraction_overlap", f"""
WITH {_FINE_SQL.strip()},
m AS (SELECT fine_row, fine_col, year, CASE WHEN doy IS NOT NULL THEN CAST(doy > 0 AS DOUBLE) END AS v FROM fine),
r AS (SELECT DISTINCT fine_row, ({GRID_Y0} - {OTHER["y0"]} + fine_row * ({FINE_DY})) / ({OTHER["dy"]}) AS lo,
             ({GRID_Y0} - {OTHER["y0"]} + (fine_row + 1) * ({FINE_DY})) / ({OTHER["dy"]}) AS hi FROM m),
c AS (SELECT DISTINCT fine_col, ({GRID_X0} - ({OTHER["x0"]}) + fine_col * {FINE_DX}) / {OTHER["dx"]} AS lo,
             ({GRID_X0} - ({OTHER["x0"]}) + (fine_col + 1) * {FINE_DX}) / {OTHER["dx"]} AS hi FROM m),
rw AS (SELECT fine_row, k AS grid_row, (least(hi, k + 1.0) - greatest(lo, CAST(k AS DOUBLE))) / (hi - lo) AS w
       FROM r, (SELECT CAST(range AS INTEGER) AS k FROM range({OTHER["height"]})) t WHERE k >= floor(lo) AND k <= ceil(hi) - 1),
cw AS (SELECT fine_col, k AS grid_col, (least(hi, k + 1.0) - greatest(lo, CAST(k AS DOUBLE))) / (hi - lo) AS w
       FROM c, (SELECT CAST(range AS INTEGER) AS k FROM range({OTHER["width"]})) t WHERE k >= floor(lo) AND k <= ceil(hi) - 1)
SELECT grid_row, grid_col, year, {rnd('sum(CASE WHEN v IS NOT NULL THEN rw.w * cw.w * v END) / nullif(sum(CASE WHEN v IS NOT NULL THEN rw.w * cw.w END), 0)')} AS burn_fraction,
       {rnd('coalesce(sum(CASE WHEN v IS NOT NULL THEN rw.w * cw.w END), 0)')} AS weight, {rnd('sum(rw.w * cw.w)')} AS covered
FROM m JOIN rw ON rw.fine_row = m.fine_row JOIN cw ON cw.fine_col = m.fine_col WHERE rw.w > 1e-9 AND cw.w > 1e-9 GROUP BY 1, 2, 3""")
def q_burn_fraction_overlap(spark, sf):
    """Burned fraction of cells of another grid, each fine cell split over the cells it overlaps."""
    grid = {"x0": GRID_X0, "dx": FINE_DX, "y0": GRID_Y0, "dy": FINE_DY}
    burned = _fine(spark, sf).withColumn("burn_fraction", F.when(F.col("doy").isNotNull(), (F.col("doy") > 0).cast("double")))
    return round_doubles(overlap_resample(burned, grid, OTHER, "burn_fraction", ("year",)))


def _fine_centres(spark, sf):
    f = _fine(spark, sf).select("fine_row", "fine_col", "year")
    return f.withColumns({"x": F.lit(GRID_X0) + (F.col("fine_col") + 0.5) * FINE_DX,
                          "y": F.lit(GRID_Y0) + (F.col("fine_row") + 0.5) * FINE_DY})


_FC_SQL = (f"fc AS (SELECT fine_row, fine_col, year, {GRID_X0} + (fine_col + 0.5) * {FINE_DX} AS x, "
           f"{GRID_Y0} + (fine_row + 0.5) * ({FINE_DY}) AS y FROM fine)")


@query("nearest_resample", with_obs(f"""
SELECT fc.fine_row, fc.fine_col, fc.year, {rnd('s.temperature_2m')} AS temperature_2m, {rnd('s.b1')} AS b1
FROM fc LEFT JOIN ac s ON s.grid_row = CAST(floor((fc.y - {GRID_Y0}) / ({GRID_DY})) AS INTEGER)
                      AND s.grid_col = CAST(floor((fc.x - ({GRID_X0})) / {GRID_DX}) AS INTEGER) AND s.year = fc.year
WHERE floor((fc.y - {GRID_Y0}) / ({GRID_DY})) BETWEEN 0 AND {GRID_ROWS - 1}
  AND floor((fc.x - ({GRID_X0})) / {GRID_DX}) BETWEEN 0 AND {GRID_COLS - 1}""",
    _FINE_SQL + "," + _FC_SQL + "," + __import__("cinder.plans.sqlgen", fromlist=["x"]).annual_composite_ctes()))
def q_nearest_resample(spark, sf):
    """Nearest (containing-cell) resample of the annual composite,
    including the categorical land cover, onto the fine grid."""
    ac = annual_composite(obs(spark, sf)).select("grid_row", "grid_col", "year", "temperature_2m", "b1")
    out = nearest_resample(_fine_centres(spark, sf), ac, COARSE, ["temperature_2m", "b1"], extra_keys=("year",))
    return round_doubles(out.select("fine_row", "fine_col", "year", "temperature_2m", "b1"))


@query("bilinear_resample", with_obs(f"""
SELECT fine_row, fine_col, year, {rnd('sum(w * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0)')} AS temperature_2m FROM (
  SELECT t.fine_row, t.fine_col, t.year, cl.temperature_2m AS v,
         CASE WHEN k.dc = 1 THEN t.tx ELSE 1 - t.tx END * CASE WHEN k.dr = 1 THEN t.ty ELSE 1 - t.ty END AS w
  FROM (SELECT *, fx - c0 AS tx, fy - r0 AS ty FROM (
          SELECT *, CAST(floor(fx) AS INTEGER) AS c0, CAST(floor(fy) AS INTEGER) AS r0 FROM (
            SELECT fine_row, fine_col, year, (x - ({GRID_X0})) / {GRID_DX} - 0.5 AS fx,
                   (y - {GRID_Y0}) / ({GRID_DY}) - 0.5 AS fy FROM fc) a) b) t
  CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dr, dc)
  LEFT JOIN cl ON cl.grid_row = t.r0 + k.dr AND cl.grid_col = t.c0 + k.dc) u
GROUP BY 1, 2, 3""", _FINE_SQL + "," + _FC_SQL + """,
cl AS (SELECT grid_row, grid_col, CASE WHEN (grid_row + grid_col) % 11 <> 0 THEN avg(temperature_2m) END AS temperature_2m
       FROM obs GROUP BY 1, 2)"""))
def q_bilinear_resample(spark, sf):
    """Bilinear resample of the temperature climatology onto the fine grid."""
    cl = climatology(obs(spark, sf), ["temperature_2m"]).withColumn(      # with cells that have no value
        "temperature_2m", F.when((F.col("grid_row") + F.col("grid_col")) % 11 != 0, F.col("temperature_2m")))
    out = bilinear_resample(_fine_centres(spark, sf), cl, COARSE, "temperature_2m")
    return round_doubles(out.select("fine_row", "fine_col", "year", "temperature_2m"))


@query("pixel_area", with_obs(
    f"SELECT DISTINCT grid_row, grid_col, {rnd(AREA_SQL + ' * 1e-4', 4)} AS area_ha, "
    f"{rnd(AREA_SQL + ' * 1e-10', 10)} AS area_mha FROM obs"))
def q_pixel_area(spark, sf):
    """Geographic pixel area (cos-latitude) in ha and Mha."""
    p = obs(spark, sf).select("grid_row", "grid_col", "latitude").distinct()
    a = geographic_pixel_area_m2("latitude", GRID_DX, GRID_DY)
    return p.select("grid_row", "grid_col", F.round(F.round(a * 1e-4, 10), 4).alias("area_ha"),
                    F.round(F.round(a * 1e-10, 10), 10).alias("area_mha"))


_ROUGH = (111320.0 ** 2) * abs(GRID_DX * GRID_DY)


@query("burned_area_const", with_obs(f"""
SELECT year, count(*) AS n_burned, {rnd(f'count(*) * {PIXEL_AREA_HA_4KM} / 1e6')} AS burned_mha_4km,
       {rnd(f'count(*) * {_ROUGH!r} * 1e-10', 8)} AS burned_mha_rough
FROM (SELECT grid_row, grid_col, year FROM obs GROUP BY 1, 2, 3 HAVING max(score) >= 0.5) t GROUP BY year"""))
def q_burned_area_const(spark, sf):
    """Constant-area variants (1,600 ha per 4 km pixel; rough 111320^2)."""
    m = annual_mask(obs(spark, sf), "score", 0.5).where("burned = 1")
    g = m.groupBy("year").agg(F.count(F.lit(1)).alias("n_burned"))
    return g.select("year", "n_burned",
                    F.round(F.round(F.col("n_burned") * PIXEL_AREA_HA_4KM / 1e6, 10), 6).alias("burned_mha_4km"),
                    F.round(F.round(F.col("n_burned") * _ROUGH * 1e-10, 10), 8).alias("burned_mha_rough"))


@query("grid_guard", with_obs(f"""
SELECT DISTINCT {rnd('x0')} AS x0, {rnd('dx')} AS dx, {rnd('y0')} AS y0, {rnd('dy')} AS dy, height, width, crs FROM (
  SELECT min(longitude) - {GRID_DX / 2} AS x0, {GRID_DX} AS dx, max(latitude) - ({GRID_DY / 2}) AS y0, {GRID_DY} AS dy,
         CAST(max(grid_row) + 1 AS INTEGER) AS height, CAST(max(grid_col) + 1 AS INTEGER) AS width, 'EPSG:4326' AS crs FROM obs
  UNION ALL
  SELECT {GRID_X0} + min(fine_col) * {FINE_DX}, {GRID_DX}, {GRID_Y0} + min(fine_row) * ({FINE_DY}), {GRID_DY},
         CAST(floor(max(fine_row) / {FACTOR}) + 1 AS INTEGER), CAST(floor(max(fine_col) / {FACTOR}) + 1 AS INTEGER),
         'EPSG:4326' FROM fine) g""", _FINE_SQL))
def q_grid_guard(spark, sf):
    """Distinct grid definitions across two inputs (callers assert one)."""
    o = obs(spark, sf).agg(
        (F.min("longitude") - GRID_DX / 2).alias("x0"), F.lit(GRID_DX).alias("dx"),
        (F.max("latitude") - GRID_DY / 2).alias("y0"), F.lit(GRID_DY).alias("dy"),
        (F.max("grid_row") + 1).cast("int").alias("height"), (F.max("grid_col") + 1).cast("int").alias("width"),
        F.lit("EPSG:4326").alias("crs"))
    f = _fine(spark, sf).agg(
        (F.lit(GRID_X0) + F.min("fine_col") * FINE_DX).alias("x0"), F.lit(GRID_DX).alias("dx"),
        (F.lit(GRID_Y0) + F.min("fine_row") * FINE_DY).alias("y0"), F.lit(GRID_DY).alias("dy"),
        (F.floor(F.max("fine_row") / FACTOR) + 1).cast("int").alias("height"),
        (F.floor(F.max("fine_col") / FACTOR) + 1).cast("int").alias("width"), F.lit("EPSG:4326").alias("crs"))
    return round_doubles(grid_guard([o, f]))
