"""Readers for the driver tables and the pixel-month fixture view ``obs``.

``obs`` maps the TPC-H-like tables onto the pixel-month schema of the burned-area
pipeline (one row per pixel and month).  It is built with the DataFrame API so
Catalyst prunes the ``lineitem`` / ``part`` scans to the nine columns used and
plans a partial (map-side) aggregate before the single shuffle on the pixel-month
key.  ``OBS_SQL`` is the identical definition for the DuckDB oracle.

Grid: 40 columns x 20 rows of 0.25 degree pixels, west edge -150, north edge 65.
Zones: 25 rectangles of 8 x 4 pixels, zone id = nation key, name = nation name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinder.functions.hashing import hash_uniform, sql_hash_uniform

# --- fixed values: fixture grid ---------------------------------------------
GRID_COLS = 40
GRID_ROWS = 20
GRID_X0 = -150.0          # west edge (degrees)
GRID_Y0 = 65.0            # north edge (degrees)
GRID_DX = 0.25            # pixel width (degrees)
GRID_DY = -0.25           # pixel height (degrees, north-up)
ZONE_ROWS = 4             # pixel rows per zone
ZONE_COLS = 8             # pixel cols per zone
ZONES_PER_ROW = 5

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pixel_month_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (grid_row, grid_col, year, month) with 15 predictors,
    ``fraction``, coordinates, zone, hash-uniforms, labels and a synthetic score."""
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    j = li.join(part, li.l_partkey == part.p_partkey)
    keyed = j.select(
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % GRID_ROWS).cast("int").alias("grid_row"),
        (F.col("l_partkey") % GRID_COLS).cast("int").alias("grid_col"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        "l_partkey", "l_discount", "l_quantity", "l_tax", "l_extendedprice", "l_linenumber",
        "p_retailprice", "p_size",
    )
    agg = keyed.groupBy("grid_row", "grid_col", "year", "month").agg(
        F.min(F.round(F.col("l_discount") * 10, 2)).alias("fraction"),
        F.min(F.col("p_retailprice")).alias("DEM"),
        F.min(F.col("p_size").cast("double")).alias("slope"),
        F.max(((F.col("l_partkey") * 13) % 360).cast("double")).alias("aspect"),
        F.min((F.col("p_size") % 7).cast("double")).alias("b1"),
        F.min(F.col("l_tax") * 1200).alias("relative_humidity"),
        F.min(F.col("l_tax") * 100).alias("total_precipitation_sum"),
        F.max(F.col("l_quantity") + 250).alias("temperature_2m"),
        F.min(F.col("l_quantity") + 250).alias("temperature_2m_min"),
        F.max(F.col("l_quantity") + 255).alias("temperature_2m_max"),
        F.round(F.max(F.col("l_extendedprice") % 300), 6).alias("build_up_index"),
        F.round(F.max(F.col("l_extendedprice") % 500), 6).alias("drought_code"),
        F.round(F.min(F.col("l_extendedprice") % 60), 6).alias("duff_moisture_code"),
        F.round(F.max(F.col("l_extendedprice") % 100), 6).alias("fine_fuel_moisture_code"),
        F.round(F.max(F.col("l_quantity") * F.col("l_discount")), 6).alias("fire_weather_index"),
        F.max(F.col("l_linenumber").cast("double")).alias("initial_fire_spread_index"),
    )
    key = ["grid_row", "grid_col", "year", "month"]
    label = (F.col("fraction") > 0.5).cast("int")
    return agg.select(
        *key,
        (F.lit(GRID_X0) + F.col("grid_col") * GRID_DX + GRID_DX / 2).alias("longitude"),
        (F.lit(GRID_Y0) + F.col("grid_row") * GRID_DY + GRID_DY / 2).alias("latitude"),
        (F.floor(F.col("grid_row") / ZONE_ROWS) * ZONES_PER_ROW
         + F.floor(F.col("grid_col") / ZONE_COLS)).cast("int").alias("zone_id"),
        "fraction", *[c for c in agg.columns if c not in key and c != "fraction"],
        label.alias("label"),
        hash_uniform("score", *key).alias("u_score"),
        hash_uniform("test", *key).alias("u_test"),
        hash_uniform("neg", *key).alias("u_neg"),
        hash_uniform("fold", *key).alias("u_fold"),
    ).withColumn("score", F.col("label") * 0.6 + F.col("u_score") * 0.4)


_OBS_KEY = "grid_row, grid_col, year, month"

OBS_SQL = f"""
obs_raw AS (
  SELECT CAST((l_partkey * 7 + l_suppkey) % {GRID_ROWS} AS INTEGER) AS grid_row,
         CAST(l_partkey % {GRID_COLS} AS INTEGER) AS grid_col,
         CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month,
         min(round(l_discount * 10, 2)) AS fraction,
         min(p_retailprice) AS DEM,
         min(CAST(p_size AS DOUBLE)) AS slope,
         max(CAST((l_partkey * 13) % 360 AS DOUBLE)) AS aspect,
         min(CAST(p_size % 7 AS DOUBLE)) AS b1,
         min(l_tax * 1200) AS relative_humidity,
         min(l_tax * 100) AS total_precipitation_sum,
         max(l_quantity + 250) AS temperature_2m,
         min(l_quantity + 250) AS temperature_2m_min,
         max(l_quantity + 255) AS temperature_2m_max,
         round(max(l_extendedprice % 300), 6) AS build_up_index,
         round(max(l_extendedprice % 500), 6) AS drought_code,
         round(min(l_extendedprice % 60), 6) AS duff_moisture_code,
         round(max(l_extendedprice % 100), 6) AS fine_fuel_moisture_code,
         round(max(l_quantity * l_discount), 6) AS fire_weather_index,
         max(CAST(l_linenumber AS DOUBLE)) AS initial_fire_spread_index
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3, 4
),
obs AS (
  SELECT {_OBS_KEY},
         CAST({GRID_X0} AS DOUBLE) + grid_col * CAST({GRID_DX} AS DOUBLE) + CAST({GRID_DX / 2} AS DOUBLE) AS longitude,
         CAST({GRID_Y0} AS DOUBLE) + grid_row * CAST({GRID_DY} AS DOUBLE) + CAST({GRID_DY / 2} AS DOUBLE) AS latitude,
         CAST(floor(grid_row / {ZONE_ROWS}) * {ZONES_PER_ROW} + floor(grid_col / {ZONE_COLS}) AS INTEGER) AS zone_id,
         fraction, DEM, slope, aspect, b1, relative_humidity, total_precipitation_sum,
         temperature_2m, temperature_2m_min, temperature_2m_max, build_up_index, drought_code,
         duff_moisture_code, fine_fuel_moisture_code, fire_weather_index, initial_fire_spread_index,
         CAST(fraction > 0.5 AS INTEGER) AS label,
         {sql_hash_uniform('score', _OBS_KEY)} AS u_score,
         {sql_hash_uniform('test', _OBS_KEY)} AS u_test,
         {sql_hash_uniform('neg', _OBS_KEY)} AS u_neg,
         {sql_hash_uniform('fold', _OBS_KEY)} AS u_fold,
         CAST(fraction > 0.5 AS INTEGER) * 0.6 + {sql_hash_uniform('score', _OBS_KEY)} * 0.4 AS score
  FROM obs_raw
)"""


def with_obs(sql_body: str, extra_ctes: str = "") -> str:
    """Prefix an oracle query with the ``obs`` CTE (and optional extra CTEs)."""
    ctes = OBS_SQL + (",\n" + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{sql_body}"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone polygons from ``nation``: one part without holes per nation key.

    ``rings`` is ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>; each ring lists its
    corners with the first vertex repeated at the end.
    """
    n = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("zone_id"), F.col("n_name").alias("ecoregion"))
    zr = F.floor(F.col("zone_id") / ZONES_PER_ROW)
    zc = F.col("zone_id") % ZONES_PER_ROW
    x0 = F.lit(GRID_X0) + zc * (ZONE_COLS * GRID_DX)
    x1 = x0 + ZONE_COLS * GRID_DX
    y1 = F.lit(GRID_Y0) + zr * (ZONE_ROWS * GRID_DY)
    y0 = y1 + ZONE_ROWS * GRID_DY

    def pt(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return n.select("zone_id", "ecoregion",
                    F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))).alias("rings"))
