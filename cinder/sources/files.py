"""File-level sources and sinks.

Paths are discovered and parsed with DataFrame functions (``_metadata``,
``regexp_extract``); "skip if output exists" becomes an anti-join of pending
keys against the partitions already written; writes use dynamic partition
overwrite so a re-run replaces exactly the partitions it recomputes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinder.session import materialise

# --- fixed values: source file-name pattern (year, month) ---------------------
SOURCE_NAME_PATTERN = r"cems_e5l_firecci_(\d{4})_(\d{1,2})_new_fwi_with_fraction\.tif$"
TIME_LIKE_PATTERN = "(?i)year|time|date"


def read_projected(spark: SparkSession, path: str, schema: T.StructType | None, columns: list[str],
                   where: Column | None = None) -> DataFrame:
    """Read a (Hive-partitioned) Parquet dataset with an explicit
    schema, keep only ``columns`` (pruned in the scan) and an optional predicate
    (pushed down; on partition columns it prunes directories)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns)


def parse_year_month(path: Column, pattern: str = SOURCE_NAME_PATTERN) -> tuple[Column, Column]:
    """A5: (year, month) from a file name, case-insensitive; non-matches -> NULL."""
    rx = "(?i)" + pattern
    y = F.regexp_extract(path, rx, 1)
    m = F.regexp_extract(path, rx, 2)
    return (F.when(y != "", y.cast("int")), F.when(m != "", m.cast("int")))


def file_paths(df: DataFrame) -> DataFrame:
    """The distinct data files behind a file-source DataFrame."""
    return df.select(F.col("_metadata.file_path").alias("file_path")).distinct()


def pick_by_priority(candidates: DataFrame, unit_cols, priority_col: str = "priority",
                     exists_col: str = "exists") -> DataFrame:
    """First existing candidate per unit by priority (window per unit: a
    handful of candidate names each)."""
    w = Window.partitionBy(*unit_cols).orderBy(priority_col)
    c = candidates.where(F.col(exists_col))
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def check_unique_columns(df: DataFrame) -> None:
    """Refuse to write duplicate column names (case-insensitive)."""
    seen = [c.lower() for c in df.columns]
    dups = sorted({c for c in seen if seen.count(c) > 1})
    if dups:
        raise ValueError(f"duplicate columns {dups}")


def write_partitioned(df: DataFrame, path: str, partition_cols, mode: str = "append") -> None:
    """Append (or dynamically overwrite) a Hive-partitioned Parquet dataset.

    Rows are dealt by the partition columns, so each task writes few files per
    partition; adaptive execution splits partitions that are large."""
    check_unique_columns(df)
    (df.hint("rebalance", *partition_cols).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def safe_name(c: Column) -> Column:
    """File-system-safe partition value."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def write_per_zone(df: DataFrame, path: str, zone_col: str = "ecoregion") -> None:
    """One Parquet directory per zone (replaces lazily opened writers)."""
    write_partitioned(df.withColumn("zone_safe", safe_name(F.col(zone_col))), path, ["zone_safe"], "overwrite")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def input_stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(bytes, files, time of the last change) of a file or folder: what derived tables are kept by."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    content = fs.getContentSummary(p)
    return content.getLength(), content.getFileCount(), fs.getFileStatus(p).getModificationTime()


def existing_partitions(spark: SparkSession, path: str, partition_cols) -> DataFrame:
    """Partition values already present under ``path``; none if nothing was written
    there yet.  Any other failure to read is an error."""
    if path_exists(spark, path):
        return spark.read.parquet(path).select(*partition_cols).distinct()
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in partition_cols])
    return spark.createDataFrame([], schema)


def _unit_state(df: DataFrame, units: Sequence[str]) -> DataFrame:
    """Rows and an order-free checksum of each unit."""
    rest = [F.col(f"`{c}`") for c in sorted(df.columns) if c not in units]
    return df.groupBy(*units).agg(F.count(F.lit(1)).alias("unit_rows"),
                                  F.sum(F.xxhash64(*rest).cast("decimal(38,0)")).alias("unit_checksum"))


def write_units(df: DataFrame, path: str, manifest: str, units: Sequence[str]) -> None:
    """A10: write (or replace) whole units of a partitioned dataset, then commit them.

    A manifest row (unit, rows, checksum of the rows that were meant) is appended only
    after all data of this call are in place; a stop before leaves units uncommitted."""
    units = list(units)
    state = materialise(_unit_state(df, units), "manifest-rows")
    write_partitioned(df, path, units, "overwrite")
    state.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(manifest)


def done_units(spark: SparkSession, path: str, manifest: str, units: Sequence[str], schema: T.StructType) -> DataFrame:
    """A10: units whose files hold what the manifest's last row for them says; a unit that
    was written in part, damaged or never committed is not among them."""
    units = list(units)
    if not path_exists(spark, manifest) or not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([f for f in schema.fields if f.name in units])).select(*units)
    last = spark.read.parquet(manifest).groupBy(*units).agg(
        F.max_by(F.struct("unit_rows", "unit_checksum"), "committed_at").alias("meant"))
    held = _unit_state(spark.read.schema(schema).parquet(path), units)
    both = held.join(last, units)
    return both.where((F.col("unit_rows") == F.col("meant.unit_rows")) & F.col("unit_checksum").eqNullSafe(F.col("meant.unit_checksum"))).select(*units)


def incremental_todo(todo: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Keys still to process (left anti join)."""
    return todo.join(done, list(keys), "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """Summary sink with a header (one file per task)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Summary source with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def json_after_header(text: Column, schema: T.StructType) -> Column:
    """Parse the JSON object found after a text header line."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(body, schema)


def grid_fill(values: DataFrame, height: int, width: int, value_cols: dict[str, float | int],
              row_col: str = "grid_row", col_col: str = "grid_col") -> DataFrame:
    """Dense (row, col) grid with every cell present; cells without a value
    get the nodata value of their column.  The grid comes from two generators
    (``explode(sequence)``), not from a join."""
    spark = values.sparkSession
    rows = spark.range(height).select(F.col("id").cast("int").alias(row_col))
    dense = rows.select(row_col, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias(col_col))
    j = dense.join(values.select(row_col, col_col, *value_cols), [row_col, col_col], "left")
    return j.select(row_col, col_col, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in value_cols.items()])


def schema_inspect(df: DataFrame) -> DataFrame:
    """Columns, types and whether a column looks time-like."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    s = df.sparkSession.createDataFrame(rows, "column string, type string, position int")
    return s.withColumn("time_like", F.col("column").rlike(TIME_LIKE_PATTERN))
