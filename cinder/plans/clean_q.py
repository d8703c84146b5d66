"""Queries for labels, bins, names, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinder.functions.cleaning import (align_schema, clean_training, coerce_numeric, domain_filter,
                                       drop_invalid, null_mask_by, phys_filter, sentinel_filter)
from cinder.functions.dates import doy_range
from cinder.functions.labels import (burn_category, burn_frequency_bin, burned_label, clip01,
                                     confusion_label, fraction_bin, sigmoid, ternary_label)
from cinder.functions.names import match_names, normalize_name, sanitize_names
from cinder.operators.masks import annual_mask, prob_rescale
from cinder.plans.common import obs
from cinder.plans.registry import query
from cinder.plans.sqlgen import rnd, round_doubles
from cinder.schema import FEATURES, LAND_COVER, LAND_COVER_DEFAULT
from cinder.sources.tables import read_table, with_obs

K = "grid_row, grid_col, year, month"
KEY = ["grid_row", "grid_col", "year", "month"]
TEST_YEARS = [1999, 2000]


@query("normalize_names", "SELECT p_partkey, p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') "
                          "AS norm_name FROM part")
def q_normalize_names(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", "p_name", normalize_name("p_name").alias("norm_name"))


_BASE_SQL = ("CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN 'band' "
             "WHEN regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), "
             "'^_+|_+$', '', 'g') = '' THEN 'band' "
             "ELSE regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), "
             "'^_+|_+$', '', 'g') END")


@query("sanitize_names", f"""
SELECT p_brand, p_partkey, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS safe_name
FROM (SELECT p_brand, p_partkey, base, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS k
      FROM (SELECT p_brand, p_partkey, {_BASE_SQL} AS base FROM part) t) u""")
def q_sanitize_names(spark, sf):
    p = read_table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return sanitize_names(p, "p_name", ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "safe_name")


_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query("match_names", f"""
WITH avail AS (SELECT p_brand, p_name AS name, min(p_partkey) AS position FROM part GROUP BY 1, 2),
wanted AS (SELECT DISTINCT p_brand, wanted FROM (
    SELECT p_brand, unnest(string_split(p_name, ' ')) AS wanted FROM part
    UNION ALL SELECT p_brand, p_type FROM part UNION ALL SELECT p_brand, p_name FROM part) t),
cand AS (SELECT w.p_brand, w.wanted, a.name AS matched, a.position,
                CASE WHEN {_NORM.format('w.wanted')} = {_NORM.format('a.name')} THEN 0 ELSE 1 END AS prio
         FROM wanted w JOIN avail a ON w.p_brand = a.p_brand
          AND (contains({_NORM.format('a.name')}, {_NORM.format('w.wanted')})
               OR contains({_NORM.format('w.wanted')}, {_NORM.format('a.name')})))
SELECT p_brand, wanted, matched, position FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand, wanted ORDER BY prio, position) AS rn FROM cand) x
WHERE rn = 1""")
def q_match_names(spark, sf):
    p = read_table(spark, sf, "part")
    avail = p.groupBy("p_brand", F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("position"))
    words = p.select("p_brand", F.explode(F.split("p_name", " ")).alias("wanted"))
    wanted = (words.unionByName(p.select("p_brand", F.col("p_type").alias("wanted")))
                   .unionByName(p.select("p_brand", F.col("p_name").alias("wanted"))).distinct())
    return match_names(wanted, avail, "wanted", "name", "position", ["p_brand"]).select(
        "p_brand", "wanted", "matched", "position")


@query("doy_range", with_obs(
    "SELECT DISTINCT year, month, CAST(dayofyear(make_date(year, month, 1)) AS INTEGER) AS doy1, "
    "CAST(dayofyear(last_day(make_date(year, month, 1))) AS INTEGER) AS doy2 FROM obs"))
def q_doy_range(spark, sf):
    d1, d2 = doy_range("year", "month")
    return obs(spark, sf).select("year", "month").distinct().select("year", "month", d1.alias("doy1"),
                                                                    d2.alias("doy2"))


@query("label_burned", with_obs(
    f"SELECT {K}, {rnd('greatest(0.0, least(1.0, fraction))')} AS fraction_clipped, "
    "CAST(fraction > 0.5 AS INTEGER) AS burned FROM obs"))
def q_label_burned(spark, sf):
    o = obs(spark, sf)
    return round_doubles(o.select(*KEY, clip01("fraction").alias("fraction_clipped"),
                                  burned_label("fraction").alias("burned")))


@query("label_ternary", with_obs(
    "SELECT burned_pixel, count(*) AS n FROM (SELECT CASE WHEN fraction > 0.5 THEN 1 WHEN fraction < 0.5 THEN 0 END "
    "AS burned_pixel FROM obs) t GROUP BY 1"))
def q_label_ternary(spark, sf):
    o = obs(spark, sf)
    return o.groupBy(ternary_label("fraction").alias("burned_pixel")).agg(F.count(F.lit(1)).alias("n"))


@query("fraction_bins", with_obs(
    f"SELECT {K}, bin FROM (SELECT {K}, CASE WHEN fraction <= 0.0 + 1e-8 THEN 0 "
    "WHEN fraction >= 0.01 - 1e-8 AND fraction <= 0.33 + 1e-8 THEN 1 "
    "WHEN fraction >= 0.34 - 1e-8 AND fraction <= 0.66 + 1e-8 THEN 2 "
    "WHEN fraction >= 0.67 - 1e-8 AND fraction <= 1.00 + 1e-8 THEN 3 END AS bin FROM obs) t WHERE bin IS NOT NULL"))
def q_fraction_bins(spark, sf):
    o = obs(spark, sf).select(*KEY, fraction_bin("fraction").alias("bin"))
    return o.where(F.col("bin").isNotNull())


@query("coerce_numeric",
       "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END "
       "AS DOUBLE) AS value FROM part")
def q_coerce_numeric(spark, sf):
    p = read_table(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", coerce_numeric(raw).alias("value"))


_RAW_SQL = ("CAST(CASE WHEN grid_col % 9 = 0 THEN 'inf' WHEN grid_col % 11 = 0 THEN '-inf' "
            "WHEN grid_row % 7 = 0 THEN 'NaN' ELSE CAST(fire_weather_index AS VARCHAR) END AS DOUBLE)")


def _raw_col():
    return F.when(F.col("grid_col") % 9 == 0, F.lit("inf")).when(F.col("grid_col") % 11 == 0, F.lit("-inf")) \
        .when(F.col("grid_row") % 7 == 0, F.lit("NaN")).otherwise(F.col("fire_weather_index").cast("string")) \
        .cast("double")


@query("drop_invalid", with_obs(
    f"SELECT {K}, {rnd('v')} AS v FROM (SELECT {K}, {_RAW_SQL} AS v FROM obs) t "
    "WHERE NOT isnan(v) AND NOT isinf(v) AND v IS NOT NULL"))
def q_drop_invalid(spark, sf):
    o = obs(spark, sf).select(*KEY, _raw_col().alias("v"))
    return round_doubles(drop_invalid(o, ["v"]))


_CLEAN_FEATS = [f for f in FEATURES if f != "b1"]


@query("clean_training", with_obs(
    f"SELECT {K}, burned_pixel, CAST(round_even(b1, 0) AS INTEGER) AS b1, "
    + ", ".join(f"{rnd(c)} AS {c}" for c in _CLEAN_FEATS)
    + " FROM (SELECT *, CASE WHEN fraction > 0.5 THEN 1 WHEN fraction < 0.5 THEN 0 END AS burned_pixel FROM obs) t "
    "WHERE build_up_index >= 0 AND drought_code >= 0 AND duff_moisture_code >= 0 AND fine_fuel_moisture_code >= 0 "
    "AND burned_pixel IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)))
def q_clean_training(spark, sf):
    c = clean_training(obs(spark, sf))
    return round_doubles(c.select(*KEY, "burned_pixel", "b1", *_CLEAN_FEATS))


@query("phys_filter", with_obs(
    f"SELECT {K} FROM obs WHERE NOT (coalesce(relative_humidity > 80, false) OR coalesce(temperature_2m < 270, false) "
    "OR coalesce(fine_fuel_moisture_code < 50, false) OR coalesce(initial_fire_spread_index < 2, false))"))
def q_phys_filter(spark, sf):
    return phys_filter(obs(spark, sf)).select(*KEY)


@query("sentinel_filter", with_obs(
    f"SELECT {K}, {rnd('neg_dem')} AS neg_dem FROM (SELECT {K}, fraction, -(DEM + 50) AS neg_dem FROM obs) t "
    "WHERE NOT (neg_dem < -1000 OR fraction < -1000)"))
def q_sentinel_filter(spark, sf):
    o = obs(spark, sf).select(*KEY, "fraction", (-(F.col("DEM") + 50)).alias("neg_dem"))
    return round_doubles(sentinel_filter(o).select(*KEY, "neg_dem"))


@query("domain_filter", with_obs(f"SELECT {K} FROM obs WHERE DEM > 950 AND build_up_index IS NOT NULL"))
def q_domain_filter(spark, sf):
    return domain_filter(obs(spark, sf), min_dem=950.0).select(*KEY)


@query("null_mask_by", with_obs(
    f"SELECT {K}, {rnd('CASE WHEN lab IS NOT NULL THEN fire_weather_index END')} AS fwi_masked FROM "
    f"(SELECT *, CASE WHEN fraction > 0.5 THEN 1 WHEN fraction < 0.5 THEN 0 END AS lab FROM obs) t"))
def q_null_mask_by(spark, sf):
    o = obs(spark, sf).withColumn("lab", ternary_label("fraction"))
    return round_doubles(o.select(*KEY, null_mask_by("fire_weather_index", "lab").alias("fwi_masked")))


_CONF_SQL = ("CASE WHEN obs_label IS NULL OR pred_label IS NULL THEN 'NA' "
             "WHEN pred_label = 1 AND obs_label = 1 THEN 'TP' WHEN pred_label = 0 AND obs_label = 1 THEN 'FN' "
             "WHEN pred_label = 0 AND obs_label = 0 THEN 'TN' WHEN pred_label = 1 AND obs_label = 0 THEN 'FP' "
             "ELSE 'NA' END")
_CONF_SRC = ("(SELECT *, CASE WHEN fraction > 0.5 THEN 1 WHEN fraction < 0.5 THEN 0 END AS obs_label, "
             "CAST(u_score > 0.5 AS INTEGER) AS pred_label FROM obs)")


def _confusion(spark, sf):
    o = obs(spark, sf).withColumns({"obs_label": ternary_label("fraction"),
                                    "pred_label": (F.col("u_score") > 0.5).cast("int")})
    return o.withColumn("pred_obs", confusion_label("obs_label", "pred_label"))


@query("confusion_label", with_obs(f"SELECT {K}, {_CONF_SQL} AS pred_obs FROM {_CONF_SRC} t"))
def q_confusion_label(spark, sf):
    return _confusion(spark, sf).select(*KEY, "pred_obs")


@query("tpfp_mask", with_obs(
    f"SELECT {K} FROM (SELECT *, {_CONF_SQL} AS pred_obs FROM {_CONF_SRC} t) u WHERE upper(pred_obs) IN ('TP', 'FP')"))
def q_tpfp_mask(spark, sf):
    """Keep pixel-months flagged TP or FP (case-insensitive)."""
    c = _confusion(spark, sf)
    return c.where(F.upper("pred_obs").isin("TP", "FP")).select(*KEY)


_REBURN_CTE = """reburn AS (SELECT grid_row, grid_col, CAST(sum(burned) AS BIGINT) AS burn_count FROM (
  SELECT grid_row, grid_col, year, CAST(max(score) >= 0.5 AS INTEGER) AS burned FROM obs GROUP BY 1, 2, 3) t
  GROUP BY 1, 2)"""


def _reburn(spark, sf):
    m = annual_mask(obs(spark, sf), "score", 0.5)
    return m.groupBy("grid_row", "grid_col").agg(F.sum("burned").cast("bigint").alias("burn_count"))


@query("reburn_count", with_obs("SELECT * FROM reburn", _REBURN_CTE))
def q_reburn_count(spark, sf):
    """Number of burned years per pixel."""
    return _reburn(spark, sf)


@query("burn_category", with_obs(
    "SELECT grid_row, grid_col, burn_count, CASE WHEN burn_count = 0 THEN '0: Never Burned' "
    "WHEN burn_count <= 5 THEN '1-5 Times' WHEN burn_count <= 10 THEN '6-10 Times' "
    "ELSE '11+ Times (Hyper-Active)' END AS burn_category FROM reburn", _REBURN_CTE))
def q_burn_category(spark, sf):
    r = _reburn(spark, sf)
    return r.withColumn("burn_category", burn_category("burn_count"))


@query("burn_frequency_bins", with_obs(
    "SELECT freq_bin, count(*) AS n_pixels FROM (SELECT CASE WHEN burn_count = 1 THEN '1 time' "
    "WHEN burn_count >= 2 THEN CAST(2 + CAST(floor((burn_count - 2) / 4) AS INTEGER) * 4 AS VARCHAR) || '-' || "
    "CAST(2 + CAST(floor((burn_count - 2) / 4) AS INTEGER) * 4 + 3 AS VARCHAR) || ' times' END AS freq_bin "
    "FROM reburn) t WHERE freq_bin IS NOT NULL GROUP BY 1", _REBURN_CTE))
def q_burn_frequency_bins(spark, sf):
    r = _reburn(spark, sf).withColumn("freq_bin", burn_frequency_bin("burn_count"))
    return r.where(F.col("freq_bin").isNotNull()).groupBy("freq_bin").agg(F.count(F.lit(1)).alias("n_pixels"))


_LC_VALUES = ", ".join(f"({k}, '{v}')" for k, v in LAND_COVER.items())


@query("landcover_label", with_obs(
    f"SELECT {K}, CAST(b1 AS INTEGER) AS b1, coalesce(d.label, '{LAND_COVER_DEFAULT}') AS landcover "
    f"FROM obs LEFT JOIN (VALUES {_LC_VALUES}) d(code, label) ON CAST(obs.b1 AS INTEGER) = d.code"))
def q_landcover_label(spark, sf):
    """Code -> label with default; the dictionary is a fixed ~40-row table
    (broadcast)."""
    d = spark.createDataFrame([(k, v) for k, v in LAND_COVER.items()], "code int, lc_label string")
    o = obs(spark, sf).withColumn("b1", F.col("b1").cast("int"))
    j = o.join(F.broadcast(d), o["b1"] == d["code"], "left")
    return j.select(*KEY, "b1", F.coalesce("lc_label", F.lit(LAND_COVER_DEFAULT)).alias("landcover"))


@query("sigmoid_score", with_obs(f"SELECT {K}, {rnd('1.0 / (1.0 + exp(-((score - 0.5) * 10)))')} AS prob FROM obs"))
def q_sigmoid_score(spark, sf):
    o = obs(spark, sf)
    return round_doubles(o.select(*KEY, sigmoid((F.col("score") - 0.5) * 10).alias("prob")))


@query("prob_rescale", with_obs(
    f"SELECT {K}, {rnd('coalesce(score / nullif(score + 99.0 * (1 - score), 0), 0.0)')} AS prob_rescaled FROM obs"))
def q_prob_rescale(spark, sf):
    o = obs(spark, sf)
    return round_doubles(o.select(*KEY, prob_rescale("score").alias("prob_rescaled")))


@query("annual_mask", with_obs(
    "SELECT grid_row, grid_col, year, CAST(max(score) >= 0.5 AS INTEGER) AS burned FROM obs GROUP BY 1, 2, 3"))
def q_annual_mask(spark, sf):
    """Any month with p >= 0.5."""
    return annual_mask(obs(spark, sf), "score", 0.5)


_ALIGN_SCHEMA = T.StructType([T.StructField("grid_row", T.IntegerType()), T.StructField("grid_col", T.IntegerType()),
                              T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
                              T.StructField("DEM", T.DoubleType()), T.StructField("fraction", T.DoubleType()),
                              T.StructField("temperature_2m", T.DoubleType())])


@query("align_schema", with_obs(
    f"SELECT {K}, {rnd('DEM')} AS DEM, {rnd('fraction')} AS fraction, {rnd('temperature_2m')} AS temperature_2m "
    f"FROM (SELECT {K}, DEM, fraction, NULL AS temperature_2m FROM obs WHERE year <= 1997 "
    f"UNION ALL SELECT {K}, NULL AS DEM, fraction, temperature_2m FROM obs WHERE year > 1997) t"))
def q_align_schema(spark, sf):
    """Two files with different band sets -> one canonical schema."""
    o = obs(spark, sf)
    a = o.where("year <= 1997").select(*KEY, "DEM", "fraction", "slope")        # extra column dropped
    b = o.where("year > 1997").select(*KEY, "fraction", "temperature_2m")       # DEM missing
    u = a.unionByName(b, allowMissingColumns=True)
    return round_doubles(align_schema(u, _ALIGN_SCHEMA))


@query("temporal_split", with_obs(
    f"SELECT {K}, CASE WHEN year IN ({', '.join(map(str, TEST_YEARS))}) THEN 'test' ELSE 'train' END AS role "
    "FROM obs WHERE year BETWEEN 1995 AND 2001"))
def q_temporal_split(spark, sf):
    """Hold out the test years; year range bounds."""
    o = obs(spark, sf).where(F.col("year").between(1995, 2001))
    return o.select(*KEY, F.when(F.col("year").isin(TEST_YEARS), "test").otherwise("train").alias("role"))
