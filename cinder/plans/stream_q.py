"""Streaming queries (S1, S2): monthly files land in two installments; each
installment is processed by an ``availableNow`` run of the same checkpointed
stream; the result table is read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinder.plans.common import obs
from cinder.plans.registry import query
from cinder.plans.sqlgen import rnd, round_doubles
from cinder.session import scratch_path
from cinder.sources.tables import with_obs
from cinder.streaming.incremental import incremental_annual_mask, incremental_ingest

KEY = ["grid_row", "grid_col", "year", "month"]
# The later years land first, and one month arrives half in each installment.
def _first():
    half = (F.col("year") == 1997) & (F.col("month") == 6) & (F.pmod(F.col("grid_row") + F.col("grid_col"), F.lit(2)) == 0)
    return (F.col("year") >= 1998) | half

MONTH_SCHEMA = T.StructType([
    T.StructField("grid_row", T.IntegerType()), T.StructField("grid_col", T.IntegerType()),
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("fraction", T.DoubleType()), T.StructField("p", T.DoubleType())])


def _land(spark, sf, landing: str, first: bool) -> None:
    o = obs(spark, sf).select(*KEY, "fraction", F.col("score").alias("p"))
    part = o.where(_first()) if first else o.where(~_first())
    part.write.mode("append").parquet(landing)


@query("incremental_ingest", with_obs(f"SELECT {', '.join(KEY)}, {rnd('fraction')} AS fraction FROM obs"))
def q_incremental_ingest(spark, sf):
    """File-source stream, AvailableNow, checkpoint, merge into touched partitions."""
    landing, target, ck = (scratch_path(spark, n) for n in ("landing", "ingested", "ingest_ckpt"))
    for first in (True, False):
        _land(spark, sf, landing, first)
        incremental_ingest(spark, landing, target, ck, MONTH_SCHEMA)
    return round_doubles(spark.read.parquet(target).select(*KEY, "fraction"))


@query("incremental_annual_mask", with_obs(
    f"SELECT grid_row, grid_col, year, {rnd('max(score)')} AS annual_max, CAST(max(score) >= 0.5 AS INTEGER) AS burned "
    "FROM obs GROUP BY 1, 2, 3"))
def q_incremental_annual_mask(spark, sf):
    """Streaming annual max / mask, merged into touched year partitions."""
    landing, target, ck = (scratch_path(spark, n) for n in ("scores", "annual", "annual_ckpt"))
    for first in (True, False):
        _land(spark, sf, landing, first)
        incremental_annual_mask(spark, landing, target, ck, MONTH_SCHEMA, "p", 0.5)
    return round_doubles(spark.read.parquet(target).select("grid_row", "grid_col", "year", "annual_max", "burned"))
