"""Grid geometry as column expressions and joins.

Rasters are tables keyed by explicit ``(grid_row, grid_col)``; an affine grid is
one small row ``(x0, dx, y0, dy, height, width, crs)``.  Every operator here is a
projection, an equi-join on a snapped key, or a bucketed range join; none loops
over pixels in Python.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinder.schema import METRES_PER_DEGREE


# --- B2 / B3: affine transform ------------------------------------------------

def pixel_centers(df: DataFrame, x0: float, dx: float, y0: float, dy: float,
                  row_col: str = "grid_row", col_col: str = "grid_col",
                  x_name: str = "x", y_name: str = "y") -> DataFrame:
    """Pixel-centre coordinates ``x0+(col+0.5)*dx``, ``y0+(row+0.5)*dy``."""
    return df.withColumns({
        x_name: F.lit(float(x0)) + (F.col(col_col) + 0.5) * F.lit(float(dx)),
        y_name: F.lit(float(y0)) + (F.col(row_col) + 0.5) * F.lit(float(dy)),
    })


def coord_to_cell(df: DataFrame, x_col: str, y_col: str, x0: float, dx: float, y0: float,
                  dy: float, width: int, height: int, row_name: str = "cell_row",
                  col_name: str = "cell_col") -> DataFrame:
    """Inverse transform with floor (half-open cells ``[x, x+dx)``); drops points
    outside the grid."""
    c = F.floor((F.col(x_col).cast("double") - F.lit(float(x0))) / F.lit(float(dx))).cast("int")
    r = F.floor((F.col(y_col).cast("double") - F.lit(float(y0))) / F.lit(float(dy))).cast("int")
    out = df.withColumns({row_name: r, col_name: c})
    return out.where(F.col(row_name).between(0, height - 1) & F.col(col_name).between(0, width - 1))


# --- B5 / B6: coarse snapping -------------------------------------------------

def snap(c: Column | str, size: Column | float) -> Column:
    """``size * floor(c / size)`` in DOUBLE (never DECIMAL)."""
    c = F.col(c) if isinstance(c, str) else c
    s = size if isinstance(size, Column) else F.lit(float(size))
    return (s * F.floor(c.cast("double") / s)).cast("double")


# --- B15 / B16: pixel area ----------------------------------------------------

def geographic_pixel_area_m2(lat: Column | str, dx_deg: float, dy_deg: float) -> Column:
    """``|dx|*111320*cos(lat) * |dy|*111320`` square metres."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    return (F.lit(abs(dx_deg) * METRES_PER_DEGREE) * F.cos(F.radians(lat))
            * F.lit(abs(dy_deg) * METRES_PER_DEGREE))


def projected_pixel_area_m2(dx_m: float, dy_m: float) -> Column:
    return F.lit(abs(dx_m * dy_m))


# --- B4: polar projections (spherical / ellipsoidal closed forms) ------------

WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def polar_stereographic_north(lon: Column, lat: Column, lat_ts: float = 70.0,
                              lon0: float = -45.0) -> tuple[Column, Column]:
    """Ellipsoidal north polar stereographic (variant B, EPSG:3413 defaults),
    Snyder (1987) eqs. 21-34 / 21-38 / 21-39."""
    a, f = WGS84_A, WGS84_F
    e = math.sqrt(2 * f - f * f)

    def t_of(phi: Column) -> Column:
        es = F.lit(e) * F.sin(phi)
        return F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))

    phic = math.radians(lat_ts)
    mc = math.cos(phic) / math.sqrt(1 - e * e * math.sin(phic) ** 2)
    tc = math.tan(math.pi / 4 - phic / 2) / ((1 - e * math.sin(phic)) / (1 + e * math.sin(phic))) ** (e / 2)
    phi = F.radians(lat)
    lam = F.radians(lon) - F.lit(math.radians(lon0))
    rho = F.lit(a * mc / tc) * t_of(phi)
    return rho * F.sin(lam), -rho * F.cos(lam)


_E2 = 2 * WGS84_F - WGS84_F**2
_E = math.sqrt(_E2)
_Q_POLE = 1 + (1 - _E2) / (2 * _E) * math.log((1 + _E) / (1 - _E))


def lambert_azimuthal_north(lon: Column, lat: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Ellipsoidal north polar Lambert azimuthal equal-area (EPSG:6931),
    Snyder (1987) eqs. 3-12, 24-23, 21-30, 21-31."""
    sin = F.sin(F.radians(lat))
    q = F.lit(1 - _E2) * (sin / (1 - F.lit(_E2) * sin * sin)
                          - F.lit(1 / (2 * _E)) * F.log((1 - F.lit(_E) * sin) / (1 + F.lit(_E) * sin)))
    lam = F.radians(lon) - F.lit(math.radians(lon0))
    rho = F.lit(WGS84_A) * F.sqrt(F.greatest(F.lit(_Q_POLE) - q, F.lit(0.0)))
    return rho * F.sin(lam), -rho * F.cos(lam)


def _geodetic(aux: Column, terms: tuple[float, float, float]) -> Column:
    """Latitude from an auxiliary latitude by its series in sines of even multiples."""
    return aux + F.lit(terms[0]) * F.sin(2 * aux) + F.lit(terms[1]) * F.sin(4 * aux) + F.lit(terms[2]) * F.sin(6 * aux)


def _lonlat(x: Column, y: Column, phi: Column, lon0: float) -> tuple[Column, Column]:
    lon = F.degrees(F.atan2(x, -y)) + F.lit(lon0)
    return F.when(lon < -180, lon + 360).when(lon >= 180, lon - 360).otherwise(lon), F.degrees(phi)


def lonlat_from_stereographic_north(x: Column, y: Column, lat_ts: float = 70.0, lon0: float = -45.0) -> tuple[Column, Column]:
    """Inverse of :func:`polar_stereographic_north`, Snyder (1987) eqs. 3-5, 20-16, 21-39, 21-40."""
    phic = math.radians(lat_ts)
    mc = math.cos(phic) / math.sqrt(1 - _E2 * math.sin(phic) ** 2)
    tc = math.tan(math.pi / 4 - phic / 2) / ((1 - _E * math.sin(phic)) / (1 + _E * math.sin(phic))) ** (_E / 2)
    chi = F.lit(math.pi / 2) - 2 * F.atan(F.hypot(x, y) * F.lit(tc / (WGS84_A * mc)))
    e2, e4, e6 = _E2, _E2**2, _E2**3
    terms = (e2 / 2 + 5 * e4 / 24 + e6 / 12, 7 * e4 / 48 + 29 * e6 / 240, 7 * e6 / 120)
    return _lonlat(x, y, _geodetic(chi, terms), lon0)


def lonlat_from_azimuthal_north(x: Column, y: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Inverse of :func:`lambert_azimuthal_north`, Snyder (1987) eqs. 3-18, 24-28."""
    q = F.lit(_Q_POLE) - (x * x + y * y) / F.lit(WGS84_A**2)
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / F.lit(_Q_POLE))))
    e2, e4, e6 = _E2, _E2**2, _E2**3
    terms = (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360)
    return _lonlat(x, y, _geodetic(beta, terms), lon0)


def lonlat_from_xy(df: DataFrame, x_col: str, y_col: str, crs: str) -> DataFrame:
    """Adds ``lon`` and ``lat`` (degrees) of projected coordinates in metres."""
    x, y = F.col(x_col).cast("double"), F.col(y_col).cast("double")
    inverse = {"EPSG:3413": lonlat_from_stereographic_north, "EPSG:6931": lonlat_from_azimuthal_north}
    if crs.upper() not in inverse:
        raise ValueError(f"unsupported CRS {crs}; only EPSG:3413 and EPSG:6931 are built")
    lon, lat = inverse[crs.upper()](x, y)
    return df.withColumns({"lon": lon, "lat": lat})


def project_lonlat(df: DataFrame, lon_col: str, lat_col: str, crs: str) -> DataFrame:
    lon, lat = F.col(lon_col).cast("double"), F.col(lat_col).cast("double")
    if crs.upper() == "EPSG:3413":
        x, y = polar_stereographic_north(lon, lat)
    elif crs.upper() == "EPSG:6931":
        x, y = lambert_azimuthal_north(lon, lat)
    else:
        raise ValueError(f"unsupported CRS {crs}; only EPSG:3413 and EPSG:6931 are built")
    return df.withColumns({"proj_x": x, "proj_y": y})


# --- B12 / E6: point-in-polygon by a cover of cells ---------------------------

def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd ray cast over ring edges (first vertex repeated at the end).

    Boundary rule: ``>=`` on y makes top edges inside and bottom edges outside;
    ``<`` on x makes left edges inside and right edges outside (left/top
    inclusive, so adjacent polygons never both claim a shared edge).  A ring of
    fewer than two vertices holds nothing."""
    n = F.size(ring)

    def step(acc, i):
        a = F.element_at(ring, i + 1)
        b = F.element_at(ring, i + 2)
        crosses = (a["y"] >= py) != (b["y"] >= py)
        xint = (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return acc != (crosses & (px < xint))

    return F.when(n >= 2, F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(False), step)).otherwise(F.lit(False))


def point_in_rings(px: Column, py: Column, rings: Column) -> Column:
    """Even-odd rule over all rings of a zone: parts add, holes cut out."""
    return F.aggregate(rings, F.lit(False), lambda inside, ring: inside != point_in_ring(px, py, ring))


LEVEL_BITS = 3          # a cell of one level is 8 cells of the level below, along its row
LEVELS = 8              # up to 8^7 cells in a row
_PAD = 1e-9             # of a cell: edges this near a cell's side count for both cells


def _edges(zones: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each edge of each ring."""
    ends = F.col("ring")
    pair = F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda i: F.struct(F.get(ends, i).alias("a"), F.get(ends, i + 1).alias("b")))
    rings = zones.select(*keys, F.explode("rings").alias("ring")).where(F.size("ring") >= 2)
    e = rings.select(*keys, F.explode(pair).alias("e"))
    return e.select(*keys, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def polygon_cover(zones: DataFrame, cell: float, zone_cols=("zone_id",)) -> DataFrame:
    """Cells that cover each zone: (zone_cols, level, cy, cx, border).

    Level 0 cells are squares of side ``cell``; a cell of level l is 8^l of them side by
    side in one row.  Border cells (level 0) are those an edge passes; between two border
    cells of a row no edge runs, so the cells there are all inside or all outside, by the
    number of edges that the row's middle line crosses up to them; runs inside are cut
    into few aligned cells of growing level.  Rows grow with the length of the border in
    cells (and the logarithm of the runs), not with the area.
    """
    b, keys = float(cell), list(zone_cols)
    index = lambda v: F.floor(v / F.lit(b)).try_cast("int")
    e = _edges(zones, keys)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = e.withColumn("cy", F.explode(F.sequence(index(low - _PAD * b), index(high + _PAD * b))))
    # The edge's part within the row of cells, and whether it crosses the row's middle line (as the ray cast counts).
    slope = F.when(F.col("by") != F.col("ay"), (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    x_at = lambda y: F.col("ax") + slope * (F.greatest(low, F.least(high, y)) - F.col("ay"))
    bottom, top, mid = F.col("cy") * b - _PAD * b, (F.col("cy") + 1) * b + _PAD * b, (F.col("cy") + 0.5) * b
    one, two = F.coalesce(x_at(bottom), F.col("ax")), F.coalesce(x_at(top), F.col("bx"))
    crosses = (F.col("ay") >= mid) != (F.col("by") >= mid)
    rows = rows.select(*keys, "cy", F.least(one, two).alias("x1"), F.greatest(one, two).alias("x2"),
                       F.when(crosses, index(x_at(mid))).alias("at"))
    cells = rows.select(*keys, "cy", "at", F.explode(F.sequence(index(F.col("x1") - _PAD * b), index(F.col("x2") + _PAD * b))).alias("cx"))
    border = cells.groupBy(*keys, "cy", "cx").agg(F.sum((F.col("at") == F.col("cx")).cast("int")).alias("n"))
    along = Window.partitionBy(*keys, "cy").orderBy("cx")                  # the border cells of one row of one zone
    walk = border.select(*keys, "cy", "cx", F.sum(F.coalesce("n", F.lit(0))).over(along).alias("before"), F.lead("cx").over(along).alias("next"))
    runs = walk.where("before % 2 = 1 and next > cx + 1").select(*keys, "cy", (F.col("cx") + 1).alias("lo"), (F.col("next") - 1).alias("hi"))

    def first(level: int) -> Column:
        return F.ceil(F.col("lo") / F.lit(float(1 << (LEVEL_BITS * level)))).cast("int")

    def last(level: int) -> Column:
        return (F.floor((F.col("hi") + 1) / F.lit(float(1 << (LEVEL_BITS * level)))) - 1).cast("int")

    def at_level(level: int, lo: Column, hi: Column) -> Column:
        return F.transform(F.sequence(lo, hi), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cx")))

    parts = []
    for level in range(LEVELS):
        own, wide = (first(level), last(level)), 1 << LEVEL_BITS
        if level == LEVELS - 1:
            rest = [own]
        else:                                            # what the level above does not hold: at its left and its right
            up = first(level + 1) <= last(level + 1)
            rest = [(own[0], F.when(up, first(level + 1) * wide - 1).otherwise(own[1])),
                    (F.when(up, (last(level + 1) + 1) * wide).otherwise(own[1] + 1), own[1])]
        for lo, hi in rest:
            parts.append(F.when(lo <= hi, at_level(level, lo, hi)))
    pieces = F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))
    inner = runs.select(*keys, "cy", F.explode(pieces).alias("p")).select(*keys, F.col("p.level").alias("level"), "cy", F.col("p.cx").alias("cx"), F.lit(False).alias("border"))
    return border.select(*keys, F.lit(0).alias("level"), "cy", "cx", F.lit(True).alias("border")).unionByName(inner)


def polygon_zone(points: DataFrame, x_col: str, y_col: str, zones: DataFrame,
                 bucket_deg: float = 1.0, zone_cols=("zone_id",)) -> DataFrame:
    """Assign each point the zones whose ``rings`` contain it (inner semantics).

    ``zones``: ``zone_cols`` (one row per zone) and ``rings``, an array of closed
    rings: any number of parts and holes.  Zones without a ring hold no point; points
    without both coordinates are in no zone.

    Plan: zones become cells (:func:`polygon_cover`), points look up their cell at each
    level that occurs, by equi-join.  Points of inner cells are done; only points of
    border cells get the rings, by zone, for the exact ray cast.  No join is hinted:
    Spark broadcasts a side by its bytes or shuffles both.
    """
    b, keys = float(bucket_deg), list(zone_cols)
    zones = zones.dropna(subset=keys)
    px, py = F.col(x_col).cast("double"), F.col(y_col).cast("double")
    cover = polygon_cover(zones, b, keys).withColumnsRenamed({k: f"_z{i}" for i, k in enumerate(keys)})
    levels = cover.select(F.sort_array(F.collect_set("level"))).scalar()      # those that occur: one small array
    cell = lambda v: F.floor(v / b).try_cast("long")
    at = (points.where(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py))
          .withColumn("_levels", levels).withColumn("_level", F.explode("_levels")).drop("_levels")
          .withColumns({"_cy": cell(py), "_cx": F.call_function("shiftright", cell(px), F.col("_level") * LEVEL_BITS)}))
    near = at.join(cover, (F.col("_level") == F.col("level")) & (F.col("_cy") == F.col("cy")) & (F.col("_cx") == F.col("cx")))
    # The ray cast's zone: null in inner cells, which need no rings.
    near = near.withColumn("_ray", F.when(F.col("border"), F.col("_z0")))
    rings = zones.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.col("rings").alias("_rings"))
    same = F.col("_ray") == F.col("_r0")
    for i in range(1, len(keys)):
        same = same & (F.col(f"_z{i}") == F.col(f"_r{i}"))
    inside = near.join(rings, same, "left").where(~F.col("border") | F.coalesce(point_in_rings(px, py, F.col("_rings")), F.lit(False)))
    return inside.select(*points.columns, *[F.col(f"_z{i}").alias(k) for i, k in enumerate(keys)])


# --- B13 / B14: square-cell masks --------------------------------------------

def cell_mask(pixels: DataFrame, cells: DataFrame, size_deg: float, flag_col: str,
              lon_col: str = "longitude", lat_col: str = "latitude",
              year_col: str | None = "year") -> DataFrame:
    """Keep pixels whose snapped coarse cell has ``flag_col == 1`` (left semi join)."""
    keys = ["big_lon", "big_lat"] + ([year_col] if year_col else [])
    flagged = cells.where(F.col(flag_col) == 1).select(*keys).distinct()
    p = pixels.withColumns({"big_lon": snap(lon_col, size_deg), "big_lat": snap(lat_col, size_deg)})
    return p.join(flagged, keys, "left_semi").drop("big_lon", "big_lat")


# --- B7 / B8 / C5: average resample of a fine day-of-year grid ---------------

def burn_fraction_monthly(fine: DataFrame, factor: int, nodata_as_zero: bool = True) -> DataFrame:
    """Monthly burned fraction of each coarse cell from a fine annual burn-date grid.

    ``fine``: ``fine_row, fine_col, year, doy`` (doy 0 = unburned, NULL = nodata).
    A fine cell burned in month m when ``doy1(m) <= doy <= doy2(m)``; the month
    is found directly from the date (an equi key), so no range join is needed.
    Coarse key = ``floor(fine / factor)`` (centre-based, not area-weighted).
    ``nodata_as_zero``: count nodata cells as unburned (``avg(coalesce(m,0))``)
    instead of ignoring them (``avg(m)``).
    """
    burn_month = F.when(F.col("doy") > 0, F.month(F.date_add(F.make_date(F.col("year"), F.lit(1), F.lit(1)),
                                                             F.col("doy") - 1)))
    f = fine.select(
        (F.floor(F.col("fine_row") / factor)).cast("int").alias("grid_row"),
        (F.floor(F.col("fine_col") / factor)).cast("int").alias("grid_col"),
        "year", burn_month.alias("burn_month"), F.col("doy").isNull().alias("nodata"))
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    # per coarse cell: counts of cells, nodata cells and burned cells per month
    per_cell = f.groupBy("grid_row", "grid_col", "year").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(F.col("nodata").cast("int")).alias("n_nodata"))
    per_month = (f.where(F.col("burn_month").isNotNull())
                  .groupBy("grid_row", "grid_col", "year", F.col("burn_month").alias("month"))
                  .agg(F.count(F.lit(1)).alias("n_burned")))
    grid = per_cell.select("*", months)
    out = grid.join(per_month, ["grid_row", "grid_col", "year", "month"], "left")
    nb = F.coalesce(F.col("n_burned"), F.lit(0))
    denom = F.col("n_all") if nodata_as_zero else (F.col("n_all") - F.col("n_nodata"))
    return out.select("grid_row", "grid_col", "year", "month",
                      F.try_divide(nb.cast("double"), denom).alias("burn_fraction"))


_SLIVER = 1e-9         # a share below it is rounding where two cells' sides meet


def overlap_resample(fine: DataFrame, fine_grid: dict, coarse_grid: dict, value_col: str, keys: tuple = ()) -> DataFrame:
    """Average of a fine grid on any coarser one, each fine cell split over the cells
    it overlaps by the shared part of its area.

    ``fine``: ``fine_row, fine_col, keys, value_col`` (null: no data).  Grids are dicts of
    ``x0, dx, y0, dy, width, height``; they need not nest or share an origin.  Returns per
    coarse cell ``grid_row, grid_col, keys, value_col`` (mean over the covered part with
    data, null without any), ``weight`` (fine cells' area with data in it, in fine cells)
    and ``covered`` (with or without data).  A fine cell inside the coarse grid gives
    weights that sum to 1, so sums of ``value * weight`` are kept; parts outside are left out.

    Rows are split per axis by two generators of a few cells each; one grouped sum."""
    def parts(index: str, axis: str, size: str) -> Column:
        # Edges in units of coarse cells; a negative step on both grids gives ascending units too.
        unit = lambda k: (F.lit(fine_grid[f"{axis}0"] - coarse_grid[f"{axis}0"]) + (F.col(index) + k) * F.lit(fine_grid[f"d{axis}"])) / F.lit(coarse_grid[f"d{axis}"])
        one, two = unit(0), unit(1)
        low, high = F.least(one, two), F.greatest(one, two)
        whole = F.sequence(F.floor(low).cast("int"), (F.ceil(high) - 1).cast("int"))
        split = F.transform(whole, lambda c: F.struct(c.alias("cell"), ((F.least(high, c + 1.0) - F.greatest(low, c.cast("double"))) / (high - low)).alias("w")))
        return F.filter(split, lambda p: (p["w"] > _SLIVER) & p["cell"].between(0, coarse_grid[size] - 1))

    d = (fine.withColumn("_r", F.explode(parts("fine_row", "y", "height"))).withColumn("_c", F.explode(parts("fine_col", "x", "width"))))
    w, v = F.col("_r.w") * F.col("_c.w"), F.col(value_col).cast("double")
    known = F.when(v.isNotNull() & ~F.isnan(v), w)
    return d.groupBy(F.col("_r.cell").alias("grid_row"), F.col("_c.cell").alias("grid_col"), *keys).agg(
        F.try_divide(F.sum(known * v), F.sum(known)).alias(value_col),
        F.coalesce(F.sum(known), F.lit(0.0)).alias("weight"), F.sum(w).alias("covered"))


# --- B9 / B11: nearest resample ----------------------------------------------

def nearest_resample(target: DataFrame, source: DataFrame, src_grid: dict, value_cols: list[str],
                     x_col: str = "x", y_col: str = "y", extra_keys: tuple = ()) -> DataFrame:
    """Value of the source cell containing each target pixel centre (equi-join)."""
    t = coord_to_cell(target, x_col, y_col, src_grid["x0"], src_grid["dx"], src_grid["y0"],
                      src_grid["dy"], src_grid["width"], src_grid["height"], "src_row", "src_col")
    s = source.select(F.col("grid_row").alias("src_row"), F.col("grid_col").alias("src_col"),
                      *extra_keys, *value_cols)
    return t.join(s, ["src_row", "src_col", *extra_keys], "left").drop("src_row", "src_col")


# --- B10: bilinear resample ---------------------------------------------------

def bilinear_resample(target: DataFrame, source: DataFrame, src_grid: dict, value_col: str,
                      x_col: str = "x", y_col: str = "y", extra_keys: tuple = ()) -> DataFrame:
    """Bilinear interpolation from the four source centres around each target
    point: one 4-way explode + equi-join + weighted sum.  Weights are renormalised
    over the neighbours that have a value; a point without any comes back NULL."""
    fx = (F.col(x_col) - F.lit(src_grid["x0"])) / F.lit(src_grid["dx"]) - 0.5
    fy = (F.col(y_col) - F.lit(src_grid["y0"])) / F.lit(src_grid["dy"]) - 0.5
    t = target.withColumns({"_fx": fx, "_fy": fy}).withColumns({
        "_c0": F.floor("_fx").cast("int"), "_r0": F.floor("_fy").cast("int")})
    t = t.withColumns({"_tx": F.col("_fx") - F.col("_c0"), "_ty": F.col("_fy") - F.col("_r0")})
    corners = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)])
    t = t.withColumn("_k", F.explode(corners))
    t = t.withColumns({
        "src_row": F.col("_r0") + F.col("_k.dr"), "src_col": F.col("_c0") + F.col("_k.dc"),
        "_w": F.when(F.col("_k.dc") == 1, F.col("_tx")).otherwise(1 - F.col("_tx"))
        * F.when(F.col("_k.dr") == 1, F.col("_ty")).otherwise(1 - F.col("_ty"))})
    s = source.select(F.col("grid_row").alias("src_row"), F.col("grid_col").alias("src_col"),
                      *extra_keys, F.col(value_col).alias("_v"))
    j = t.join(s, ["src_row", "src_col", *extra_keys], "left")
    keep = [c for c in target.columns]
    return (j.groupBy(*keep)
             .agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")),
                               F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))).alias(value_col)))


# --- B17: grid guard ----------------------------------------------------------

def grid_guard(grids: list[DataFrame]) -> DataFrame:
    """One row per distinct grid definition across inputs; callers assert 1."""
    cols = ["x0", "dx", "y0", "dy", "height", "width", "crs"]
    u = reduce(lambda a, b: a.unionByName(b), [g.select(*cols) for g in grids])
    return u.distinct()
