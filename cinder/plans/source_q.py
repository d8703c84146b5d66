"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinder.plans.common import obs
from cinder.plans.flagship import ZONAL_SQL, zonal_burned_area_df
from cinder.plans.registry import query
from cinder.plans.sqlgen import rnd, round_doubles
from cinder.session import scratch_path
from cinder.sources.files import (SOURCE_NAME_PATTERN, done_units, existing_partitions, grid_fill, incremental_todo,
                                  json_after_header, parse_year_month, pick_by_priority, read_csv,
                                  read_projected, schema_inspect, write_csv, write_partitioned, write_per_zone, write_units)
from cinder.sources.tables import GRID_COLS, GRID_ROWS, read_table, with_obs

KEY = ["grid_row", "grid_col", "year", "month"]
K = ", ".join(KEY)

LINEITEM_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_shipdate", T.TimestampNTZType())])


@query("scan_project", "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem WHERE l_discount > 0.05")
def q_scan_project(spark, sf):
    """Explicit schema, projection and a pushed-down predicate."""
    path = f"{sf.rstrip('/')}/lineitem.parquet"
    return read_projected(spark, path, LINEITEM_SCHEMA, ["l_orderkey", "l_partkey", "l_shipdate"],
                          F.col("l_discount") > 0.05)


def _written_obs(spark, sf, name="obs"):
    path = scratch_path(spark, name)
    o = obs(spark, sf).select(*KEY, "fraction", "score")
    write_partitioned(o, path, ["year", "month"], "overwrite")
    return path


@query("scan_partition_filter", with_obs(
    f"SELECT {K}, {rnd('fraction')} AS fraction FROM obs WHERE year = 1998 AND month = 7"))
def q_scan_partition_filter(spark, sf):
    """A3: partition predicate on (year, month) prunes directories."""
    path = _written_obs(spark, sf)
    df = read_projected(spark, path, None, KEY + ["fraction"], (F.col("year") == 1998) & (F.col("month") == 7))
    return round_doubles(df)


_NAME_SQL = ("CASE WHEN month = 12 THEN 'cems_e5l_firecci_' || year || '_' || month || '_new_fwi_with_fraction.tif.aux.xml' "
             "WHEN month % 2 = 0 THEN 'CEMS_E5L_FireCCI_' || year || '_' || month || '_NEW_FWI_WITH_FRACTION.TIF' "
             "ELSE 'cems_e5l_firecci_' || year || '_' || lpad(CAST(month AS VARCHAR), 2, '0') || '_new_fwi_with_fraction.tif' END")


def _names(spark, sf):
    ym = obs(spark, sf).select("year", "month").distinct()
    y, m = F.col("year").cast("string"), F.col("month").cast("string")
    name = (F.when(F.col("month") == 12, F.concat(F.lit("cems_e5l_firecci_"), y, F.lit("_"), m,
                                                  F.lit("_new_fwi_with_fraction.tif.aux.xml")))
             .when(F.col("month") % 2 == 0, F.concat(F.lit("CEMS_E5L_FireCCI_"), y, F.lit("_"), m,
                                                     F.lit("_NEW_FWI_WITH_FRACTION.TIF")))
             .otherwise(F.concat(F.lit("cems_e5l_firecci_"), y, F.lit("_"), F.lpad(m, 2, "0"),
                                 F.lit("_new_fwi_with_fraction.tif"))))
    return ym.select(name.alias("file_name"))


@query("parse_source_name", with_obs(
    "SELECT file_name, CAST(NULLIF(regexp_extract(file_name, '(?i)" + SOURCE_NAME_PATTERN + "', 1), '') AS INTEGER) AS year, "
    "CAST(NULLIF(regexp_extract(file_name, '(?i)" + SOURCE_NAME_PATTERN + "', 2), '') AS INTEGER) AS month "
    f"FROM (SELECT DISTINCT {_NAME_SQL} AS file_name FROM obs) t"))
def q_parse_source_name(spark, sf):
    """A5: (year, month) parsed from source file names, case-insensitive;
    non-matching names (sidecars) give NULLs."""
    n = _names(spark, sf)
    y, m = parse_year_month(F.col("file_name"))
    return n.select("file_name", y.alias("year"), m.alias("month"))


_PREFIX = "MCD64A1_burn"


@query("pick_source_by_priority", with_obs(f"""
SELECT year, month, name, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY priority) AS rn FROM (
    SELECT c.year, c.month, p.priority,
           '{_PREFIX}_' || c.year || '_' || CASE WHEN p.priority IN (1, 3) THEN CAST(c.month AS VARCHAR)
                                                ELSE lpad(CAST(c.month AS VARCHAR), 2, '0') END
             || CASE WHEN p.priority <= 2 THEN '.tif' ELSE '' END AS name,
           (c.n + p.priority) % 3 <> 0 AS ex
    FROM (SELECT year, month, count(*) AS n FROM obs GROUP BY 1, 2) c, range(1, 5) p(priority)) a
  WHERE ex) b WHERE rn = 1"""))
def q_pick_source_by_priority(spark, sf):
    """First existing file-name candidate per (year, month): `_M` before
    `_MM`, with suffix before without."""
    c = obs(spark, sf).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("priority", F.explode(F.sequence(F.lit(1), F.lit(4))))
    m = F.when(F.col("priority").isin(1, 3), F.col("month").cast("string")).otherwise(
        F.lpad(F.col("month").cast("string"), 2, "0"))
    name = F.concat(F.lit(f"{_PREFIX}_"), F.col("year").cast("string"), F.lit("_"), m,
                    F.when(F.col("priority") <= 2, F.lit(".tif")).otherwise(F.lit("")))
    c = c.withColumns({"name": name, "exists": (F.col("n") + F.col("priority")) % 3 != 0})
    return pick_by_priority(c, ["year", "month"]).select("year", "month", "name",
                                                         F.col("priority").cast("bigint").alias("priority"))


@query("common_years", with_obs(
    "SELECT year FROM obs INTERSECT SELECT CAST(year(o_orderdate) AS INTEGER) FROM orders"))
def q_common_years(spark, sf):
    """Years present in both sources."""
    a = obs(spark, sf).select("year")
    b = read_table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    return a.intersect(b)


@query("partitioned_write", with_obs(f"SELECT {K}, {rnd('fraction')} AS fraction, {rnd('score')} AS score FROM obs"))
def q_partitioned_write(spark, sf):
    """Write the pixel-month table partitioned by (year, month) and read it back."""
    path = _written_obs(spark, sf)
    return round_doubles(spark.read.parquet(path).select(*KEY, "fraction", "score"))


@query("partition_by_zone", with_obs(
    "SELECT regexp_replace(regexp_replace(trim(n_name), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS zone_safe, "
    "count(*) AS n_rows FROM obs JOIN nation ON obs.zone_id = nation.n_nationkey GROUP BY 1"))
def q_partition_by_zone(spark, sf):
    """One directory per zone with a safe name; read back and count."""
    o = obs(spark, sf)
    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("ecoregion"))
    path = scratch_path(spark, "zones")
    write_per_zone(o.join(n, "zone_id").select(*KEY, "ecoregion", "fraction"), path)
    return spark.read.parquet(path).groupBy("zone_safe").agg(F.count(F.lit(1)).alias("n_rows"))


@query("incremental_todo", with_obs("SELECT DISTINCT year, month FROM obs WHERE year > 1997"))
def q_incremental_todo(spark, sf):
    """(year, month) units not yet written (resume after a stop)."""
    o = obs(spark, sf)
    path = scratch_path(spark, "resume")
    write_partitioned(o.where("year <= 1997").select(*KEY, "fraction"), path, ["year", "month"], "overwrite")
    todo = o.select("year", "month").distinct()
    return incremental_todo(todo, existing_partitions(spark, path, ["year", "month"]), ["year", "month"])


@query("resume_by_manifest", with_obs("SELECT DISTINCT year, month FROM obs WHERE NOT (year <= 1996 AND NOT (year = 1995 AND month <= 3))"))
def q_resume_by_manifest(spark, sf):
    """A10: units left after a stop: some are committed, some written without a commit, and
    some damaged after it; only whole committed units count as done."""
    o = obs(spark, sf).select(*KEY, "fraction")
    data, manifest = scratch_path(spark, "units"), scratch_path(spark, "manifest")
    write_units(o.where("year <= 1996"), data, manifest, ["year", "month"])
    write_partitioned(o.where("year = 1997 AND grid_col < 20"), data, ["year", "month"], "append")      # stopped half way
    write_partitioned(o.where("year = 1995 AND month <= 3 AND grid_row < 10"), data, ["year", "month"], "append")   # written twice in part
    done = done_units(spark, data, manifest, ["year", "month"], o.schema)
    return incremental_todo(o.select("year", "month").distinct(), done, ["year", "month"])


_ZONAL_SCHEMA = T.StructType([T.StructField("zone_id", T.IntegerType()), T.StructField("ecoregion", T.StringType()),
                              T.StructField("year", T.IntegerType()), T.StructField("burned_mha", T.DoubleType())])


@query("csv_roundtrip", ZONAL_SQL)
def q_csv_roundtrip(spark, sf):
    """Write the zonal summary as CSV with header; read back with a schema."""
    path = scratch_path(spark, "zonal_csv")
    write_csv(zonal_burned_area_df(spark, sf), path)
    return read_csv(spark, path, _ZONAL_SCHEMA)


_META_SCHEMA = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
                             T.StructField("best_iteration", T.IntegerType())])


@query("json_meta_extract", with_obs(
    f"SELECT year, {rnd('round(avg(u_score), 6)')} AS threshold, CAST(sum(label) % 500 AS INTEGER) AS best_iteration "
    "FROM obs GROUP BY year"))
def q_json_meta_extract(spark, sf):
    """Model sidecars (a text header line, then JSON) written per year and
    parsed back with ``from_json``."""
    o = obs(spark, sf).groupBy("year").agg(F.round(F.avg("u_score"), 6).alias("threshold"),
                                           (F.sum("label") % 500).cast("int").alias("best_iteration"))
    text = F.concat(F.lit("# model metadata for year "), F.col("year").cast("string"), F.lit("\n"),
                    F.to_json(F.struct("year", "threshold", "best_iteration")))
    path = scratch_path(spark, "meta")
    # one sidecar file per year (rows of a year go to one task)
    (o.select(text.alias("value"), F.col("year").alias("model_year")).repartition("model_year")
      .write.mode("overwrite").partitionBy("model_year").text(path))
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(json_after_header(F.col("value"), _META_SCHEMA).alias("m")).select("m.*")
    return round_doubles(parsed)


@query("grid_fill", with_obs(f"""
SELECT CAST(r AS INTEGER) AS grid_row, CAST(c AS INTEGER) AS grid_col, {rnd('coalesce(o.score, -9999.0)')} AS prob,
       coalesce(o.label, 255) AS cls
FROM range(0, {GRID_ROWS}) rr(r) CROSS JOIN range(0, {GRID_COLS}) cc(c)
LEFT JOIN (SELECT * FROM obs WHERE year = 1998 AND month = 7) o ON o.grid_row = rr.r AND o.grid_col = cc.c"""))
def q_grid_fill(spark, sf):
    """Dense grid for one month; nodata -9999 (prob) and 255 (class)."""
    o = obs(spark, sf).where("year = 1998 AND month = 7").select("grid_row", "grid_col", F.col("score").alias("prob"),
                                                                 F.col("label").alias("cls"))
    return round_doubles(grid_fill(o, GRID_ROWS, GRID_COLS, {"prob": -9999.0, "cls": 255}))


@query("schema_inspect")
def q_schema_inspect(spark, sf):
    """Column list of the pixel-month table with time-like flags."""
    return schema_inspect(obs(spark, sf))
